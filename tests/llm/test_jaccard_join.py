"""Similarity components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm.data import Bag, docs, odd_rows, words
from pyspark.sql import functions as F

from pactline.llm import graph
from pactline.llm import jaccard_join as jj
from pactline.llm.graph import components
from pactline.llm.text import sliced


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, k, percent):
    sets = [(i, d, shingles(t, k)) for i, (d, t, *_) in enumerate(rows)]
    bag = Bag(range(len(rows)))
    for i, _, x in sets:
        for j, _, y in sets:
            if i < j and x and y and 100 * len(x & y) >= percent * len(x | y):
                bag.link(i, j)
    least = {}
    for i, d, _ in sets:
        root = bag.root(i)
        known = [v for v in (least.get(root), d) if v is not None]
        least[root] = min(known, default=None)
    return sorted(((d, len(x), least[bag.root(i)]) for i, d, x in sets), key=repr)


def found(spark, rows, k, percent):
    frame = jj.jaccard_components(docs(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def variants(seed=2):
    """Groups of near copies around the threshold, with a line that all documents share."""
    rng = random.Random(seed)
    line, rows = words(rng, 12), []
    for _ in range(12):
        base = words(rng, rng.choice([6, 25, 60, 150]))
        for _ in range(rng.choice([1, 2, 9, 14])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(["changed", "other", "New"])
            rows.append((len(rows), " ".join(own + line * rng.choice([0, 1]))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, crowd", [(4, 85, 0), (5, 80, 16)])
def test_equals_all_pairs(spark, monkeypatch, k, percent, crowd):
    monkeypatch.setattr(jj, "CROWD", crowd)
    rows = variants()
    assert found(spark, rows, k, percent) == expected(rows, k, percent)


def test_chains_and_short_texts(spark):
    rows = [(9, "a b c d e f g h"), (3, "A B c d e f g h"), (7, "x y"), (8, "X  y"), (5, "x y z"), (6, None), (2, "")]
    assert found(spark, rows, 4, 85) == expected(rows, 4, 85)


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(spark, rows, 4, 85) == expected(rows, 4, 85)
    assert found(spark, [], 4, 85) == []


def test_one_of_each_keeps_one_row(spark):
    rows = odd_rows()
    kept = jj.one_of_each(docs(spark, rows), 5, 80)
    assert kept.columns == docs(spark, []).columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    alone = [r[:2] for r in rows if not shingles(r[1], 5)]
    assert sorted((x for x in left if not shingles(x[1], 5)), key=repr) == sorted(alone, key=repr)
    same = rows[4][1]
    assert [x for x in left if x[1] and x[1].startswith(same)] == [(4, same)]
    assert {x[0] for x in left} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}


def test_prefixes_share_as_many_tokens_as_they_promise(spark):
    rows = [(i, t) for i, t in variants(4)]
    frame = docs(spark, rows).selectExpr("doc_id as id", "0L as row", "text").coalesce(1)
    sets = frame.mapInArrow(jj._sets(5, 80, False), jj.SETS).selectExpr("*", "id as uid")
    prefix = {}
    for p in jj.prefixes(sets, sets, 80).collect():
        prefix.setdefault(p.id, {})[p.token] = (p.level, p.shared)
    whole = {i: shingles(t, 5) for i, t in rows}
    for i, x in whole.items():
        for j, y in whole.items():
            if i < j and x != y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = prefix[i], prefix[j]
                least = min(next(iter(a.values()))[1], next(iter(b.values()))[1])
                assert sum(a[t][0] <= least and b[t][0] <= least for t in a.keys() & b.keys()) >= least


@pytest.mark.parametrize("k, percent", [(5, 80), (4, 85)])
def test_a_line_of_all_documents_is_in_few_prefixes(spark, k, percent):
    rng = random.Random(14)
    line = words(rng, 30)
    rows = [(i, " ".join(words(rng, rng.randint(90, 400)) + line)) for i in range(150)]
    frame = docs(spark, rows).selectExpr("doc_id as id", "0L as row", "text").coalesce(1)
    sets = frame.mapInArrow(jj._sets(k, percent, False), jj.SETS).selectExpr("*", "id as uid").cache()
    lists = {}
    for p in jj.prefixes(sets, sets, percent).collect():
        lists.setdefault(p.token, set()).add(p.id)
    # Documents with enough rarer tokens are not in a list of the line.
    assert max(map(len, lists.values()), default=0) <= 15


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_not_shuffled(spark, monkeypatch):
    plans, inner = [], graph.written

    def recorded(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return inner(frame)

    monkeypatch.setattr(graph, "written", recorded)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    few = sorted(components(edges).collect())
    assert len(plans) > 2 and not any("Exchange hash" in plan for plan in plans[1:])
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(components(edges).collect()) == few == [(i, 0) for i in range(21)]


def test_a_document_takes_part_in_few_crowded_lists(spark):
    placed = spark.range(30).crossJoin(spark.range(40).withColumnRenamed("id", "token")).withColumn("crowded", F.expr("token < 25"))
    for draw in (0, 1):
        chosen = {}
        for r in jj.few_lists(placed, draw).collect():
            chosen.setdefault(r.id, set()).add(r.token)
        assert len(chosen) == 30 and len(set(map(frozenset, chosen.values()))) == 1
        assert all(len(own) == jj.LISTS and max(own) < 25 for own in chosen.values())


def test_sketches_differ_in_no_more_cells_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 5000))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)]))
        apart = len(np.setxor1d(x, y))
        for cells in (jj.SKETCH_BITS, 4096, 8192):
            a, b = jj.odd_sketch(x, cells), jj.odd_sketch(y, cells)
            assert np.bitwise_count(a ^ b).sum() <= apart
            assert (jj.narrowed(a, 128) == jj.odd_sketch(x)).all()


def test_long_near_copies_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(jj, "CROWD", 1)
    monkeypatch.setattr(jj, "LEADERS", 2)
    rng = random.Random(12)
    base, rows = words(rng, 1500), []
    for i in range(24):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice([0, 15, 25, 60, 200])):
            own[at] = "changed" + str(rng.randrange(9))
        rows.append((i, " ".join(own + words(rng, rng.choice([0, 300])))))
    assert found(spark, rows, 4, 85) == expected(rows, 4, 85)


def test_slices_hold_all_rows_in_order():
    batch = pa.record_batch({"id": list(range(50)), "text": ["x" * (i * i) for i in range(50)]})
    for size in (1, 500, 1 << 30):
        parts = list(sliced(iter([batch, batch.slice(0, 0)]), size))
        assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(50))
        assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(list(sliced(iter([batch]), 1))) == 50 and len(list(sliced(iter([batch]), 1 << 30))) == 1
