"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash of their content and queue up one
after the other, as often as the source may repeat. A copy's virtual finish time is
the number of its source's tokens up to and including it, divided by the source's
target: at time 1 each source has sent its target. All copies are range-sorted by
finish time and taken while the running total stays within the budget.

Running totals are two-level so that no source passes through one task: sums per
slice of the shuffle order, a window over these sums, and a window inside each slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.store import written
from pactline.llm.text import table, text_of, word_count


def slice_bits(rows: int) -> int:
    """About twice the square root of the rows in slices, so that slices and the list of slices stay short."""
    return max(1, math.ceil(math.log2(max(1, rows)) / 2) + 1)


def running_total(frame: DataFrame, value: str, order: list[Column], cut: Column, keys: list[str], out: str):
    """frame with out: the sum of value over rows up to this one in order, per keys.

    cut numbers the slices and must rise with order. Equal places share a total only
    if they tie in every column of order.
    """
    cut_frame = frame.withColumn("_cut", cut)
    sums = cut_frame.groupBy(*keys, "_cut").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_cut", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = [cut_frame[k].eqNullSafe(sums[k]) for k in [*keys, "_cut"]]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = cut_frame.join(sums, condition, "left").select(cut_frame["*"], sums["_before"])
    inside = W.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_cut", "_before")


def targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size -> with target: tokens to take of each source.

    Weights repeat over the sources by code point, null last. A target stops at
    most * source_size; what is left over is dealt again by weight until none is
    above. The level at which all hold follows from one pass in order of
    source_size / weight. One row per source: small beside the documents, sorted in
    one task.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    dealt = sizes.withColumn("weight", F.element_at(cycle, place)).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size")
    )
    everything = W.partitionBy()
    rise = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    dealt = (
        dealt.withColumn("budget", budget)
        .withColumn("_filled", F.sum("cap").over(rise.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_left", F.sum("weight").over(rise.rowsBetween(0, W.unboundedFollowing)))
    )
    level = (F.col("budget") - F.coalesce("_filled", F.lit(0.0))) / F.col("_left")
    # The first source that the level leaves below its cap, and with it all later ones.
    dealt = dealt.withColumn("_level", F.when(level * F.col("weight") <= F.col("cap"), level))
    dealt = dealt.withColumn("_level", F.first("_level", True).over(rise.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least("cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return dealt.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"), "budget")


def shuffle_key(id_column: str, text: Column) -> Column:
    """The place of a document in its source's queue: fixed by its id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), text))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=(1, 2, 3),
    share: float = 1.0,
    most: int = 3,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (tokens; repeats counted) for every row.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source
    of its own. Rows that agree in id and text keep their own places in the queue.
    Other columns are ignored, whatever their names. No rows give no rows.
    """
    text = text_of(text_column)
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(text).alias("size"),
        shuffle_key(id_column, text).alias("_key"),
    )
    # Rows alike in every respect are counted, not told apart by an unstable number.
    sized = written(sized.groupBy("source", "doc_id", "size", "_key").agg(F.count(F.lit(1)).alias("_n")))
    goals = written(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, share, most))
    named = sized.join(goals, sized["source"].eqNullSafe(goals["source"]), "left").select(
        sized["*"], "source_size", "target", "budget"
    )
    bits = slice_bits(sized.count())
    by_key = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), max(0, 32 - bits))
    queued = running_total(
        named.withColumn("_words", F.col("size") * F.col("_n")), "_words",
        [F.col("_key"), F.col("doc_id"), F.col("size")], by_key, ["source"], "_upto",
    )
    copies = queued.filter("size > 0").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_nth")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_round"))
    sent = F.col("_round") * F.col("source_size") + F.col("_upto") - (F.col("_n") - F.col("_nth")) * F.col("size")
    copies = written(copies.select(
        "source", "doc_id", "size", "_key", "_nth", "_round", "budget", F.when(F.col("target") > 0, sent / F.col("target")).alias("_finish"),
    ).filter("_finish is not null"))
    # Finish times spread evenly over [0, most * largest size / target]; slices of equal width.
    place = F.floor(F.col("_finish") * (1 << bits)).cast("long")
    order = [F.col("_finish"), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("_round"), F.col("_nth")]
    sorted_out = running_total(copies, "size", order, place, [], "_total")
    taken = (
        sorted_out.filter(F.col("_total") <= F.col("budget"))
        .groupBy("source", "doc_id", "size", "_key", "_nth")
        .agg(F.sum("size").alias("taken"))
    )
    rows = named.select(
        "source", "doc_id", "size", "_key", "source_size", "target",
        F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_nth"),
    )
    same = (
        rows["source"].eqNullSafe(taken["source"]) & rows["doc_id"].eqNullSafe(taken["doc_id"])
        & (rows["_key"] == taken["_key"]) & (rows["size"] == taken["size"]) & (rows["_nth"] == taken["_nth"])
    )
    return rows.join(taken, same, "left").select(
        rows["doc_id"], rows["source"], rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


WORDS_SQL = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

OP5_SQL = rf"""
with sized as (
  select doc_id, source, {WORDS_SQL}::bigint as size, md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as k
  from documents
), per as (
  select source, sum(size)::bigint as source_size, 3.0::double * sum(size) as cap,
    [1.0::double, 2.0, 3.0][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as weight
  from sized group by source
), levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (rise rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (rise rows between current row and unbounded following) as level,
    sum(source_size) over () as budget
  from per window rise as (order by cap / weight, source is null, encode(source))
), goals as (
  select source, source_size, budget, least(cap, coalesce(
    first_value(case when level * weight <= cap then level end ignore nulls) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and unbounded following) * weight, cap)) as target
  from levels
), queued as (
  select s.*, g.source_size, g.target, g.budget,
    sum(size) over (partition by s.source order by k, doc_id rows between unbounded preceding and current row) as upto
  from sized s join goals g on s.source is not distinct from g.source
), copies as (
  select *, (r * source_size + upto)::double / target as finish from queued, range(3) as t(r) where size > 0 and target > 0
), running as (
  select *, sum(size) over (order by finish, source nulls first, k, doc_id, r rows between unbounded preceding and current row) as total from copies
), got as (
  select source, k, doc_id, sum(size) as taken from running where total <= budget group by all
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::bigint as taken
from queued q left join got g on q.source is not distinct from g.source and q.k = g.k and q.doc_id is not distinct from g.doc_id
"""
