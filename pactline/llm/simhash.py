"""SimHash fingerprints and all pairs of them within a few bits, by pigeonring filtering.

A fingerprint is cut into SEGMENTS parts that lie in a ring. Where two fingerprints
differ in at most `bits` bits, some segment starts a chain of neighbours in which the
first l segments together differ in at most l * bits / SEGMENTS bits, for every l at once;
the plain pigeonhole principle promises a single segment only. The budgets of short
chains are zero, then one: so a chain's first segments agree, and among those that may
differ in one bit all but one agree. These agreeing segments are a key of the pair, which
an equi-join meets; the whole chain is checked on what meets, then the Hamming distance.

* Only distinct fingerprints are joined; copies are counted first, with partial sums.
* A pair can agree in several keys. It is taken in the first of them, so no pair is met
  twice and nothing needs to be made distinct.
* A key that more than CROWD fingerprints have is split by what it leaves open: those bits
  are cut into bits + 1 parts, one of which agrees as well. That goes on until keys are
  small, or leave so few bits open that they cannot have many fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.graph import components
from pactline.llm.store import hot_and_rest, written
from pactline.llm.text import LOWER_BYTES, row_hash, table, text_of

WORDS = 3
BITS = 3
SEED = 42
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Fingerprints of one key from which on it is split.
CROWD = 16
#: Bits left open by a key that is not split again: at most 2^OPEN fingerprints have it.
OPEN = 10
#: Shingles hashed in one go, so that a very long text takes no more memory than a short one.
STRETCH = 1 << 16

_ALL = (1 << 64) - 1


def shingle_hashes(text: str, k: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every run of k words, joined by one blank; of the whole text where it has fewer, none of none."""
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return
    size = min(k, len(words))
    for base in range(0, len(words) - size + 1, STRETCH):
        part = words[base : base + STRETCH + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = zip(starts[: len(part) - size + 1].tolist(), ends[size - 1 :].tolist())
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts], np.uint64)


def fingerprint(text: str, k: int = WORDS) -> int:
    """The bits that are set in over half the shingles' hashes, as a signed number."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, k):
        total += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(cell.as_py(), k) for cell in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], marks], ["doc_id", "row", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, k: int = WORDS, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, row, fingerprint (long) for every row; zero for null, empty and blank texts."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    return rows.mapInArrow(_fingerprints(k), "doc_id long, row long, fingerprint long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ring(start: int, count: int) -> int:
    """Mask of count neighbouring segments of the ring."""
    return sum(((1 << WIDTH) - 1) << (WIDTH * ((start + i) % SEGMENTS)) for i in range(count))


def budgets(bits: int) -> list[int]:
    """Bits in which the first 1, 2, ... segments of a chain may differ."""
    return [length * bits // SEGMENTS for length in range(1, SEGMENTS + 1)]


def key_masks(bits: int) -> list[tuple[int, int]]:
    """(start of the chain, mask of agreeing bits): one of them holds for each pair within `bits` bits."""
    allowed = budgets(bits)
    sure, single = sum(b == 0 for b in allowed), sum(b == 1 for b in allowed)
    masks = []
    for start in range(SEGMENTS):
        whole = _ring(start, sure + single)
        masks += [(start, whole & ~_ring(start + sure + i, 1)) for i in range(single)] if single else [(start, whole)]
    return masks


def parts_of(mask: int, bits: int) -> list[int]:
    """The bits that a key leaves open, cut into bits + 1 parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in free[i :: bits + 1]) for i in range(bits + 1)]


def _agrees(difference: Column, mask: int) -> Column:
    return difference.bitwiseAND(F.lit(_signed(mask))) == 0


def _chain_fits(difference: Column, start: int, bits: int) -> Column:
    """All prefixes of the chain are within their budgets; the longest is the Hamming check."""
    fits = []
    for length, allowed in enumerate(budgets(bits), 1):
        # A longer chain of the same budget says more.
        if length == SEGMENTS or budgets(bits)[length] > allowed:
            fits.append(F.bit_count(difference.bitwiseAND(F.lit(_signed(_ring(start, length))))) <= allowed)
    return reduce(lambda x, y: x & y, fits)


def _split(bits: int):
    """Each row of a crowded key with all keys that it is split into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mark, way, start, kept, before in zip(*(batch.column(i).to_pylist() for i in range(5))):
                finer = [_signed(kept & _ALL | part) for part in parts_of(kept & _ALL, bits)]
                for i, mask in enumerate(finer):
                    out.append((mark, way * 8 + i + 1, start, mask, before + finer[:i], mark & mask))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mark", "way", "start", "kept", "before", "key"])

    return run


def near_pairs(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """a < b: all pairs of the distinct fingerprints (mark) that differ in at most `bits` bits, each once."""
    if not 0 < bits < SEGMENTS:
        raise ValueError(f"fingerprints are joined at 1 to {SEGMENTS - 1} bits")
    masks = [(start, _signed(kept)) for start, kept in key_masks(bits)]
    # A pair is taken in the first chain that fits, there in the first mask, or part of it, that agrees.
    earlier = [[m for s, m in masks[:i] if s == start] for i, (start, _) in enumerate(masks)]
    difference = F.col("r.mark").bitwiseXOR(F.col("s.mark"))
    home = F.coalesce(*[F.when(_chain_fits(difference, start, bits), F.lit(start)) for start in range(SEGMENTS)])
    first = ~F.exists("r.before", lambda m: difference.bitwiseAND(m) == 0)

    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<long>")
    way = F.col("way").cast("int")
    told = {
        "start": F.get(F.array(*[F.lit(start) for start, _ in masks]), way), "kept": F.get(listed(m for _, m in masks), way),
        "before": F.get(F.array(*[listed(e) for e in earlier]), way),
    }
    keyed = [F.struct(F.lit(w).cast("long").alias("way"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for w, (_, m) in enumerate(masks)]
    level, pairs = marks.select("mark", F.explode(F.array(*keyed)).alias("at")).select("mark", "at.*"), []
    while True:
        level = written(level)
        rows = level if pairs else level.withColumns(told)
        sizes = rows.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n"), F.first("kept").alias("kept")).filter("n > 1")
        crowded = (F.col("n") > CROWD) & (64 - F.bit_count("kept") > OPEN)
        sizes = written(sizes.select("way", "key", crowded.alias("crowded")))
        shared = level.join(sizes, ["way", "key"])
        shared = shared if pairs else shared.withColumns(told)
        r, s = shared.filter("not crowded").alias("r"), shared.filter("not crowded").select("way", "key", "mark").alias("s")
        same = (F.col("r.way") == F.col("s.way")) & (F.col("r.key") == F.col("s.key")) & (F.col("r.mark") < F.col("s.mark"))
        pairs.append(r.join(s, same & (home == F.col("r.start")) & first).select(F.col("r.mark").alias("a"), F.col("s.mark").alias("b")))
        if sizes.filter("crowded").isEmpty():
            return reduce(DataFrame.unionByName, pairs)
        level = shared.filter("crowded").select("mark", "way", "start", "kept", "before").mapInArrow(
            _split(bits), "mark long, way long, start int, kept long, before array<long>, key long"
        )


def simhash_components(docs: DataFrame, k: int = WORDS, bits: int = BITS, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, row, fingerprint, component_id for every row.

    component_id is the smallest doc_id among rows whose fingerprints reach each other by
    links of at most `bits` differing bits. Null, empty and blank texts and those of equal
    words have equal fingerprints and are one component. A null id takes part; it is the
    component's only where no other is there. Repeated rows are rows like others; other
    columns are ignored; no rows give no rows.
    """
    rows = written(fingerprints(docs, k, id_column, text_column))
    classes = written(rows.groupBy(F.col("fingerprint").alias("mark")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    named = written(components(near_pairs(classes.select("mark"), bits)))
    placed = classes.join(named, classes["mark"] == named["node"], "left").withColumn("component", F.coalesce("component", "mark"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # Few components have several fingerprints; the others' ids are known.
    several = ids.join(named.select("component").distinct(), "component", "left_semi")
    alone = classes.join(named, classes["mark"] == named["node"], "left_anti").select("mark", F.col("least").alias("component_id"), "n")
    linked = placed.join(several, "component").select("mark", "component_id", "n")
    return hot_and_rest(rows, written(alone.unionByName(linked)), "fingerprint", "mark").select("doc_id", "row", "fingerprint", "component_id")


def op12_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in three bits or fewer."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
