"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

Two sets whose similarity reaches the threshold share at least l tokens among the
first |r| - ceil(threshold |r|) + l of each, in any order common to all sets. Rare
tokens come first in ours. Each document chooses its own l: a longer prefix reads
more postings but asks for more shared tokens before a pair is verified, and the
estimated cost of both decides.

* Documents with equal sets form one class; one of each class is joined.
* Frequencies are needed only for a fixed share of the token space, LIGHT times the share of
  a set that is its prefix: a set's tokens there are more than its prefix, as a rule; where
  they are fewer the prefix goes on with the other tokens by hash. The order stays common to all.
* Candidates come in rounds. First every document meets one document of each of its
  posting lists, the one most of which is found elsewhere: as many pairs as postings.
  What these pairs connect needs no further check. In lists that are still crowded with
  other components, documents then meet leaders drawn anew, as long as that links many.
  The last round looks at all pairs of a list whose documents are in different
  components, each outside the list's largest against all others.
* Odd sketches (parities of a set's tokens in SKETCH_BITS cells) differ in at most as many
  cells as two sets differ in tokens. They decide before whole sets are made and moved,
  and inside the join of crowded lists; sets of more tokens than cells have a wide one too,
  of a bit or two a token. So a list of thousands of near copies does not
  make its square of candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.graph import components
from pactline.llm.store import boxed, sieved, written
from pactline.llm.text import grams, row_hash, sliced, table, text_of, word_hashes

#: How much larger than the share of a set that its prefix takes is the share of the token space whose
#: frequencies are counted. Were it no larger, prefixes would hold all of a set's tokens there, frequent ones too.
LIGHT = 1.75
TOKEN_BITS = 48
MOST_SHARED = 4
#: Cost of verifying a candidate, in postings read.
VERIFY = 8.0
#: Documents outside a list's largest component from which on leaders are drawn and sketches joined.
CROWD = 16
#: Crowded lists that a document takes part in in a round, leaders drawn of each, those of them that a document
#: is verified against, and the share of documents of crowded lists that a round must link for another one. They
#: only choose the path: the last round is exact.
LISTS = 4
LEADERS = 64
TRIES = 4
WORTH = 0.1
SKETCH_BITS = 1024
NO_ID = (1 << 63) - 1

SETS = "id long, row long, n long, light long, digest binary, sketch array<long>, wide binary, tokens array<long>"


def needed(n, percent: int):
    """Least overlap of a set of n with any set that is similar to it."""
    return -(-n * percent // 100)


def _longest(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + MOST_SHARED)


def _border(percent: int) -> np.uint64:
    """The tokens below it are those whose frequencies are counted."""
    return np.uint64(min(1.0, LIGHT * (100 - percent) / 100) * (1 << 32)) << np.uint64(32)


def odd_sketch(tokens: np.ndarray, cells: int = SKETCH_BITS) -> np.ndarray:
    """Parities of the numbers of tokens in cells (a power of two of them), as packed bytes."""
    at = (tokens & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8))


def narrowed(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same tokens in size bytes, a power of two."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sets(k: int, percent: int, whole: bool):
    """Rows of SETS; with whole, the full sets as packed 64-bit numbers instead of prefix tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = _border(percent)
        for batch in sliced(batches):
            ns, lights, digests, sketches, wides, tokens = [], [], [], [], [], []
            for cell in batch.column(2):
                own = np.unique(grams(word_hashes(cell.as_py().encode()), k))
                ns.append(len(own))
                if whole:
                    tokens.append(own.tobytes())
                    continue
                light = int(np.searchsorted(own, border))
                lights.append(light)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sketches.append(odd_sketch(own).view(np.int64))
                wides.append(odd_sketch(own, 1 << int(len(own) - 1).bit_length()).tobytes() if len(own) > SKETCH_BITS else None)
                tokens.append((own[: max(light, _longest(len(own), percent))] >> np.uint64(64 - TOKEN_BITS)).astype(np.int64))
            n = pa.array(ns, pa.int64())
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(tokens, pa.binary())], ["id", "n", "set"])
                continue
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), pa.int32()),
                pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], n, pa.array(lights, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(wides, pa.binary()), lists],
                ["id", "row", "n", "light", "digest", "sketch", "wide", "tokens"],
            )

    return run


def prefixes(sets: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """token, id, n, level, shared, weight: the postings of each head's prefix that occur elsewhere too.

    level is the least l at which the token belongs to the prefix; shared is the l
    that the document chose.
    """
    postings = sets.select(F.posexplode("tokens").alias("place", "token"), F.col("uid").alias("id"))
    # Counted by a part of the token, in short rows: what is unique in it is unique.
    part = (F.col("token").bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")
    counts = postings.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = written(postings.join(counts, part == F.col("part")).select("token", "df", "id", "place"))
    # Copies were counted; from here on one document stands for each class.
    known = known.join(heads.select(F.col("uid").alias("id"), "n", "light"), "id")
    light = F.col("place") < F.col("light")
    own = W.partitionBy("id")
    # How much of a document is found elsewhere: most of all in what its copies were made from.
    known = known.withColumn("weight", F.count(F.lit(1)).over(own) / F.greatest("light", F.lit(1)))
    ranked = known.withColumn("_light", light).withColumn(
        "_nth", F.row_number().over(W.partitionBy("id", "_light").orderBy("df", "token"))
    )
    alone = F.col("light") - F.sum(F.col("_light").cast("int")).over(own)
    ranked = ranked.withColumn("rank", F.when(F.col("_light"), alone + F.col("_nth") - 1).otherwise(F.col("place")))
    overlap = F.ceil(F.col("n") * percent / 100)
    base = F.col("n") - overlap + 1
    ranked = ranked.withColumns({"_base": base, "_most": F.least(overlap, F.lit(MOST_SHARED))}).filter(
        F.col("rank") < F.col("_base") + F.col("_most") - 1
    )
    options = []
    for l in range(1, MOST_SHARED + 1):  # noqa: E741
        read = F.sum(F.when(F.col("rank") < F.col("_base") + l - 1, F.col("df") - 1).otherwise(0)).over(own)
        # A pair that shares l tokens takes l of the postings read.
        options.append(F.when(F.lit(l) <= F.col("_most"), F.struct((read * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l"))))
    ranked = ranked.withColumn("shared", F.array_min(F.array_compact(F.array(*options)))["l"])
    level = F.greatest(F.lit(1), F.col("rank") - F.col("_base") + 2).cast("int")
    return ranked.select("token", "id", "n", level.alias("level"), "shared", "weight").filter("level <= shared")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                r, s = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(r) > len(s):
                    r, s = s, r
                at = np.searchsorted(s, r)
                both = int((s[np.minimum(at, len(s) - 1)] == r).sum()) if len(s) else 0
                keep.append(100 * both >= percent * (len(r) + len(s) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    first = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    second = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")


def _wide_fit(percent: int):
    """Pairs whose wide sketches, where both have one, do not differ in more cells than similar sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for n, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if not (x.is_valid and y.is_valid):
                    keep.append(True)
                    continue
                r, s = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                size = min(len(r), len(s))
                apart = int(np.bitwise_count(narrowed(r, size) ^ narrowed(s, size)).sum())
                keep.append(apart * (100 + percent) <= n * (100 - percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sizes_fit(a: str, b: str, percent: int):
    x, y = F.col(a), F.col(b)
    return (x * 100 >= y * percent) & (y * 100 >= x * percent)


def _sketches_fit(a: str, b: str, percent: int):
    """Whether sets can be similar by n and sketch: sets that are differ in (100 - percent) / (100 + percent) of both sizes at most."""
    cells = [F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH_BITS // 64)]
    return reduce(Column.__add__, cells) * (100 + percent) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - percent)


def checked(pairs: DataFrame, rows: DataFrame, sets: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of heads that are links: by their sketches, then by whole sets, made of what is left."""
    sides = [sets.select(F.col("uid").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch")) for s in "ab"]
    # Written for their number, which is known then: few are broadcast, and sketches and sets stay where they are.
    pairs = written(pairs)
    close = written(pairs.join(sides[0], "a").join(sides[1], "b").filter(_sketches_fit("a_", "b_", percent)).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n")))
    sides = [sets.filter("wide is not null").select(F.col("uid").alias(s), F.col("wide").alias(f"wide_{s}")) for s in "ab"]
    close = close.join(sides[0], "a", "left").join(sides[1], "b", "left").select("a", "b", "n", "wide_a", "wide_b")
    pairs = written(close.mapInArrow(_wide_fit(percent), "a long, b long"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    asked = written(heads.join(asked, "uid", "left_semi").select("uid", F.col("id").alias("_id"), F.col("row").alias("_row")))
    few, _ = sieved(rows, asked.withColumnRenamed("_row", "row"))
    texts = few.join(asked, (F.col("id") == F.col("_id")) & (F.col("row") == F.col("_row")))
    whole = written(texts.select("uid", F.lit(0), "text").mapInArrow(_sets(k, percent, True), "id long, n long, set binary"))
    # Of rows that agree in id and text one is enough.
    again = sets.groupBy("id", "row").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid")).filter("c > 1").select(F.col("uid").alias("id"))
    whole = whole.join(again, "id", "left_anti").unionByName(whole.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return written(verified(pairs, whole, percent))


def open_lists(postings: DataFrame, near: DataFrame) -> DataFrame:
    """Postings of lists with several components; minor: outside the list's largest; crowded: many in the list are."""
    named = components(near).withColumnRenamed("node", "id")
    placed = postings.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all")).filter(F.col("all") > F.col("top.c"))
    tops = tops.select("token", F.col("top.component").alias("main"), (F.col("all") - F.col("top.c") > CROWD).alias("crowded"))
    return written(placed.join(tops, "token").withColumn("minor", F.col("component") != F.col("main")).drop("main"))


def sketched(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """placed with the sketches of documents of crowded lists."""
    met = placed.filter("crowded").select("id").distinct()
    own = sets.select(F.col("uid").alias("id"), "sketch").join(met, "id", "left_semi")
    return placed.join(own, "id", "left")


def few_lists(placed: DataFrame, draw: int) -> DataFrame:
    """Postings of crowded lists, LISTS a document: those of the least hashes, so that near copies choose alike."""
    chosen = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("token", F.lit(draw)), "token"))
    return placed.filter("crowded").withColumn("nth", chosen).filter(F.col("nth") <= LISTS).drop("nth")


def drawn_pairs(placed: DataFrame, sets: DataFrame, draw: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of few_lists with leaders drawn among the minor ones: LEADERS a list, TRIES a document."""
    crowd = sketched(few_lists(placed, draw), sets)
    drawn = F.row_number().over(W.partitionBy("token").orderBy(F.xxhash64("token", "id", F.lit(draw)), "id"))
    leads = crowd.filter("minor").withColumn("nth", drawn).filter(F.col("nth") <= LEADERS)
    r, s = crowd.alias("r"), leads.alias("s")
    meets = (
        (F.col("r.token") == F.col("s.token")) & (F.col("r.component") != F.col("s.component"))
        & _sizes_fit("r.n", "s.n", percent) & _sketches_fit("r.", "s.", percent)
    )
    met = r.join(s, meets).select(F.col("r.id").alias("id"), F.col("s.id").alias("lead")).distinct()
    tried = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("id", "lead", F.lit(draw)), "lead"))
    met = met.withColumn("nth", tried).filter(F.col("nth") <= TRIES)
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def crossing(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share as many prefix tokens as similar sets do."""
    placed = sketched(placed, sets)
    r, s = placed.filter("minor").alias("r"), placed.alias("s")
    meets = (
        (F.col("r.token") == F.col("s.token")) & (F.col("r.component") != F.col("s.component"))
        & (~F.col("s.minor") | (F.col("r.id") < F.col("s.id"))) & _sizes_fit("r.n", "s.n", percent)
        & (F.greatest("r.level", "s.level") <= F.least("r.shared", "s.shared"))
        & F.coalesce(_sketches_fit("r.", "s.", percent), F.lit(True))
    )
    return (
        r.join(s, meets)
        .groupBy(F.least("r.id", "s.id").alias("a"), F.greatest("r.id", "s.id").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.first(F.least("r.shared", "s.shared")).alias("l"))
        .filter("c >= l").select("a", "b")
    )


def links(rows: DataFrame, sets: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b), by uid, that connect all that is connected among the heads, which have different sets."""
    postings = written(prefixes(sets, heads, percent))
    leads = postings.groupBy("token").agg(F.max(F.struct("weight", -F.col("id"), "n")).alias("lead"))
    leads = leads.select("token", (-F.col("lead.col2")).alias("lead"), F.col("lead.n").alias("lead_n"))
    stars = postings.join(leads, "token").filter("id <> lead").filter(_sizes_fit("n", "lead_n", percent))
    stars = stars.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    near = checked(stars, rows, sets, heads, k, percent)
    placed, draw = open_lists(postings, near), 0
    while crowd := placed.filter("crowded").select("id").distinct().count():
        found = checked(drawn_pairs(placed, sets, draw, percent), rows, sets, heads, k, percent)
        many = found.count()
        if many:
            near = near.unionByName(found)
            # What has become one component stays one.
            placed = open_lists(placed.select(*postings.columns), near)
        if many < WORTH * crowd:
            break
        draw += 1
    return near.unionByName(checked(crossing(placed, sets, percent), rows, sets, heads, k, percent))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row.

    Null and empty texts have no shingles and are linked with nothing: component_id is
    their own id. Rows of one id with different texts are linked like any others. A
    null id takes part but never names a component, unless no other is there: then
    component_id is null. Other columns are ignored. No rows give no rows. kept marks
    the row content that stands for its component: the smallest id, then row.
    Shingles are compared by 64-bit hashes.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), text_of(text_column).alias("text"))
    rows = rows.select("id", row_hash(F.col("id"), F.col("text")).alias("row"), "text")
    # The number is drawn once and stored, so it stays when a task is repeated later.
    sets = written(rows.mapInArrow(_sets(k, percent, False), SETS).withColumn("uid", F.monotonically_increasing_id()))
    light = sets.select("uid", "id", "row", "n", "digest")
    classes = light.filter("n > 0").groupBy("digest").agg(F.min(F.struct("id", "row", "uid")).alias("head"))
    classes = written(classes.select("digest", "head.*"))
    heads = written(sets.select("uid", "id", "row", "n", "light").join(classes.select("uid"), "uid", "left_semi"))
    named = components(links(rows, sets, heads, k, percent))
    placed = classes.join(named, classes["uid"] == named["node"], "left").select(
        "digest", "id", "row", F.coalesce("component", "uid").alias("component")
    )
    least = placed.groupBy("component").agg(F.min(F.struct("id", "row")).alias("least"))
    placed = placed.join(least, "component").select("digest", "least")
    out = light.join(placed, (light["digest"] == placed["digest"]) & (light["n"] > 0), "left")
    first = F.coalesce("least", F.struct("id", "row"))
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "row", F.col("n").alias("n_shingles"),
        F.nullif(first["id"], F.lit(NO_ID)).alias("component_id"), (first == F.struct("id", "row")).alias("kept"),
    )


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """docs with one row of each component; rows that agree in id and text are one.

    Rows without shingles all stay.
    """
    placed = jaccard_components(docs, k, percent, id_column, text_column)
    placed = written(placed.groupBy("doc_id", "row", "kept").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")))
    # Of most rows nothing is to be decided; only the others move.
    open_ = placed.filter("not kept or (rows > 1 and n > 0)")
    key = F.col(id_column).cast("long")
    maybe, rest = sieved(boxed(docs, key, row_hash(F.coalesce(key, F.lit(NO_ID)), text_of(text_column))), open_)
    m, p = maybe.alias("m"), placed.filter("kept").alias("p")
    joined = m.join(p, F.col("m.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("m.row") == F.col("p.row"))).select("m.*", "rows", "n")
    repeated = (F.col("rows") > 1) & (F.col("n") > 0)
    once = joined.filter(~repeated)
    several = joined.filter(repeated).dropDuplicates(["doc_id", "row"])
    return rest.select("doc.*").unionByName(once.select("doc.*")).unionByName(several.select("doc.*"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) end) as gram from w
), n as (select doc_id, count(*) as n from s group by doc_id),
i as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by all
), e as (
  select x, y from i join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * common >= 85 * (nx.n + ny.n - common)
), both_ways as (select x, y from e union all select y, x from e),
reach(node, seen) as (
  select doc_id, doc_id from documents union select r.node, b.y from reach r join both_ways b on b.x = r.seen
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n using (doc_id)
join (select node, min(seen) as component_id from reach group by node) c on c.node = d.doc_id
"""
