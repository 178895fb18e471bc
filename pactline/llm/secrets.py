"""Secret scan with linking of multipart credentials.

Plain findings (assignments, access identifiers, long hexadecimal runs) are reported
as they are. Weak parts (identifiers, endpoints, random-looking words) say little
alone: each is reported only if a complementary part lies in its scope, REACH
characters to either side. Parts and scopes are cut into bins of positions, and an
interval join on (document, bin) finds which co-occur; a bin of BIN characters bounds
what meets in one place however long the document is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline.llm.store import boxed, sieved, written
from pactline.llm.text import row_hash, table, text_of

REACH = 200
BIN = 512

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_ID = re.compile(
    r"""(?ai)(?:client_?id|access_?key_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
)
ENDPOINT = re.compile(r"""(?a)(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]{4,}""")
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_secret", "weak_id", "endpoint")
SECRETS = ("assign", "hex", "weak_secret")

_PART = "array<struct<start:int,rank:int,end:int>>"
SCANNED = f"doc_id long, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_PART}, weak {_PART}"


def entropy(word: str) -> float:
    """Bits per character of a word's own letter counts."""
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the plain findings, by start, then kind."""
    spans = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that need company; those inside plain findings are left out."""
    spans = []
    low = text.lower()
    if any(k in low for k in ("client", "access", "account", "user", "login")):
        spans += [(m.start(), 4, m.end()) for m in WEAK_ID.finditer(text)]
    if "://" in text:
        spans += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if spans or any(rank == 1 for _, rank, _ in base):
        taken = [*base, *spans]
        for m in WEAK_SECRET.finditer(text):
            word = m.group()
            odd = any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and entropy(word) >= 3.5
            if odd and not any(s < m.end() and m.start() < e for s, _, e in taken):
                spans.append((m.start(), 3, m.end()))
    return sorted(s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in base))


def written_out(spans) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    as_dicts = lambda spans: [{"start": s, "rank": r, "end": e} for s, r, e in spans]
    for batch in batches:
        counts, shas, bases, weaks = [], [], [], []
        for cell in batch.column(2):
            text = cell.as_py()
            base = base_spans(text)
            ranks = Counter(rank for _, rank, _ in base)
            counts.append([ranks[k] for k in range(3)])
            shas.append(hashlib.sha256(written_out(base).encode()).hexdigest())
            bases.append(as_dicts(base))
            weaks.append(as_dicts(weak_spans(text, base)))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *columns, pa.array(shas, pa.string()), pa.array(bases, part), pa.array(weaks, part)],
            ["doc_id", "row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"],
        )


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(end / BIN)))


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of parts (doc_id, row, start, rank, end, weak) that have a complement in scope."""
    is_secret = F.col("rank").isin([KINDS.index(k) for k in SECRETS])
    scope = parts.withColumn("bin", _bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach)).filter("weak")
    there = parts.withColumn("bin", _bins(F.col("start"), F.col("end"))).withColumn("other", is_secret)
    a, b = scope.withColumn("secret", is_secret).alias("a"), there.alias("b")
    meets = (
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin"))
        & (F.col("a.secret") != F.col("b.other"))
        & (F.col("b.start") <= F.col("a.end") + reach) & (F.col("b.end") >= F.col("a.start") - reach)
    )
    return a.join(b, meets, "left_semi").select("doc_id", "row", "start", "rank", "end").distinct()


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row, the plain counts and digest, and found: all spans, for every row.

    Null and empty texts have no spans. Rows that agree in id and text get the same
    result each. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    scanned = written(rows.mapInArrow(_scan, SCANNED))
    # Rows that agree in id and text have the same parts.
    asked = scanned.filter(F.size("weak") > 0).select("doc_id", "row", "base", "weak").dropDuplicates(["doc_id", "row"])
    parts = asked.select(
        "doc_id", "row",
        F.explode(F.concat(
            F.transform("base", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), F.lit(False).alias("weak"))),
            F.transform("weak", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), F.lit(True).alias("weak"))),
        )).alias("p"),
    ).select("doc_id", "row", "p.*")
    # The parts of one document: bounded by its length.
    more = linked_parts(parts).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more"))
    s, m = scanned.alias("s"), more.alias("m")
    joined = s.join(m, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.row") == F.col("m.row")), "left")
    found = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("more"), F.array().cast(_PART))))
    return joined.select("s.doc_id", "s.row", "n_assign", "n_access", "n_hex", "base_sha256", found.alias("found"))


def spans_text(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda p: F.concat_ws(":", kinds[p["rank"]], p["start"], p["end"])), ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out, upto = [], 0
            for p in found:
                if p["end"] > upto:
                    out += [text[upto : p["start"]], f"[{KINDS[p['rank']].upper()}]"] if p["start"] >= upto else []
                    upto = p["end"]
            texts.append("".join([*out, text[upto:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "clean"])


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; documents without spans pass untouched."""
    found = scan(docs, id_column, text_column).filter(F.size("found") > 0).select("doc_id", "row", "found").dropDuplicates(["doc_id", "row"])
    found = written(found)
    key = F.col(id_column).cast("long")
    boxes = boxed(docs, key, row_hash(key, text_of(text_column)))
    maybe, rest = sieved(boxes, found)
    m, f = maybe.alias("m"), found.alias("f")
    joined = m.join(f, F.col("m.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("m.row") == F.col("f.row")), "left").select("m.doc", "f.found")
    hit = joined.filter("found is not null").select("doc", F.col("doc")[text_column].cast("string").alias("text"), "found")
    clean = hit.mapInArrow(_redact, T.StructType([boxes.schema["doc"], T.StructField("clean", T.StringType())]))
    place = {c: F.col("clean") if c == text_column else F.col("doc")[c] for c in docs.columns}
    untouched = joined.filter("found is null").select("doc.*")
    return rest.select("doc.*").unionByName(untouched).unionByName(clean.select(*[v.alias(c) for c, v in place.items()]))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text(F.col("found")).alias("spans")
    )
