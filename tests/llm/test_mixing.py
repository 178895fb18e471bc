"""Mixing: targets by repeated dealing, shares near targets, no document too often."""

import random

import pytest
from llm.data import docs, odd_rows, words
from pyspark.sql import functions as F

from pactline.llm import mixing


def dealt(sizes, weights=(1, 2, 3), most=3):
    """Targets by dealing what is left over again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total, share, left = sum(weight[s] for s in open_), left, 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def rows_of(seed, n=900):
    rng = random.Random(seed)
    sources = ["hot"] * 10 + ["a", "Z", "ä", None, "tiny"]
    return [(i, " ".join(words(rng, rng.randint(1, 25))), s) for i in range(n) for s in [rng.choice(sources) if rng.random() > 0.02 else "tiny2"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_shares(spark, seed):
    rows = rows_of(seed)
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken % r.size == 0 and r.taken <= 3 * r.size
    goal = dealt(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert sum(taken.values()) <= sum(sizes.values()) < sum(taken.values()) + 26
    assert all(abs(taken[s] - goal[s]) <= 80 for s in sizes)


def test_reruns_agree_in_any_order(spark):
    rows = rows_of(3, 200)
    a = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()), key=repr)
    b = sorted(map(tuple, mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()), key=repr)
    assert a == b


def test_odd_rows(spark):
    rows = odd_rows()
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    # The null source has no words, so the other's target is all there is.
    assert {r.target for r in got if r.source is None} == {0.0}
    total = sum(r.size for r in got)
    assert {r.target for r in got if r.source == "web"} == {float(total)} and sum(r.taken for r in got) == total
    assert mixing.mix(docs(spark, [])).collect() == []


def test_running_total_equals_one_window(spark):
    frame = spark.range(500).select(F.pmod("id", F.lit(3)).alias("k"), F.xxhash64("id").alias("h"), (F.col("id") % 7).alias("v"))
    cut = F.shiftright("h", 58)
    got = mixing.running_total(frame, "v", [F.col("h")], cut, ["k"], "t").orderBy("k", "h").collect()
    sums = {}
    for r in got:
        sums[r.k] = sums.get(r.k, 0) + r.v
        assert r.t == sums[r.k]
    assert len(got) == 500


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(docs(spark, [(1, "a b", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
