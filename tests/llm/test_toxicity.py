"""Segments against a naive scan; what the model learns, and what it must not read."""

import random
import time

import numpy as np
from llm.data import docs, odd_rows, words
from pyspark.sql import functions as F

from pactline.llm import toxicity as tx


def naive_segments(scores):
    """Maximal segments by their definition: take the best, then look to both sides of it."""
    best, n = None, len(scores)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    for i in range(n):
        for j in range(i + 1, n + 1):
            value = sums[j] - sums[i]
            if value > 1e-12 and (best is None or value > best[2] + 1e-12 or (abs(value - best[2]) <= 1e-12 and j - i < best[1] - best[0])):
                best = (i, j, value)
    if best is None:
        return []
    i, j, value = best
    right = [(a + j, b + j, v) for a, b, v in naive_segments(scores[j:])]
    return [*naive_segments(scores[:i]), best, *right]


def test_segments_equal_definition():
    rng = random.Random(4)
    for _ in range(200):
        scores = np.array([rng.choice([-3.1, -1.7, -0.4, 0.9, 2.3]) + rng.random() / 7 for _ in range(rng.randint(0, 25))])
        got = sorted((a, b, round(v, 6)) for a, b, v in tx.segments(scores))
        assert got == sorted((a, b, round(float(v), 6)) for a, b, v in naive_segments(scores))


def test_segments_of_a_very_long_clean_text_in_linear_time():
    n = 100_000
    began = time.process_time()
    got = tx.segments(np.tile([1.0, -2.0], n))
    assert got == [(2 * i, 2 * i + 1, 1.0) for i in range(n)]
    assert time.process_time() - began < 20


def corpus(spark):
    rng = random.Random(8)
    vocabulary = words(rng, 300)
    bad = ["vile", "rotten", "filth"]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        text = [rng.choice(vocabulary) for _ in range(60)]
        if toxic:
            at = rng.randrange(50)
            text[at : at + 4] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    labels += [(None, 0, 1), (3, None, None), (5, 0, 0)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    frame, labels = corpus(spark)
    model = tx.fit(frame, labels)
    scored = tx.score(frame, model).join(labels.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert sum(r.predicted == r.toxic for r in scored) >= 0.97 * len(scored)
    # Labels of the held-out fold change nothing.
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.fit(frame, turned).scores == model.scores
    kept = {r.doc_id for r in tx.without_toxic(frame, model).collect()}
    assert kept == {r.doc_id for r in scored if not r.predicted}


def test_odd_rows_and_no_labels(spark):
    frame, labels = corpus(spark)
    model = tx.fit(frame, labels)
    rows = odd_rows()
    got = tx.score(docs(spark, rows), model)
    assert got.count() == len(rows) and got.filter("score is null").count() == 0
    assert tx.without_toxic(docs(spark, rows), model).count() == len(rows)
    assert tx.score(docs(spark, []), model).count() == 0
    empty = tx.fit(frame, labels.limit(0))
    assert tx.score(frame, empty).filter("predicted = 1").count() == 0


def test_held_out_is_crc_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", tx.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
