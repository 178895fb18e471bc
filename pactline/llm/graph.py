"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.store import written

#: So many edges are few: one task has them as it would have a broadcast, and nothing is shuffled.
FEW = 1 << 14


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of edges (a, b).

    Each round hangs nodes onto the smallest neighbour of theirs; only minima are
    gathered per node, never its neighbours. Loops and repeated edges do no harm; no
    edges give no rows. A round of FEW edges or less is one task without a shuffle: shuffles
    of next to nothing fill a disk by their number of files.
    """
    together = lambda rows, edges: rows.coalesce(1) if edges <= FEW else rows
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(current)
    while before[0]:
        n = before[0]
        both = together(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(together(small.unionByName(low.select("a", F.col("m").alias("b"))), n).distinct())
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
