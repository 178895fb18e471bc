"""Toxic passages by maximum-scoring segments.

Fit, on at most SAMPLE labelled documents outside the held-out fold: log-odds of each
token between toxic and clean documents, counted once per document, under a Dirichlet
prior: LEAST_PRIOR for every token and PRIOR dealt out by overall frequency. A token scores its log-odds less a drift, so that running
text scores below zero. One linear scan finds all maximal scoring segments of a
document. Karlin-Altschul statistics turn a segment's score S in n tokens into a
p-value 1 - exp(-K n exp(-lambda S)); lambda solves the moment equation on clean text
and K comes from the clean documents' largest segments. The surprise of a document's
significant segments is summed, and a logistic curve fitted on the same sample makes
it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactline.llm.store import small_batches, written
from pactline.llm.text import row_hash, table, text_of

TOKEN = re.compile(r"[^\W_]+")
#: Labelled documents to fit on, those of the smallest id hashes; tokens kept in the model, those of the largest z.
SAMPLE = 20_000
VOCABULARY = 50_000
PRIOR = 500.0
LEAST_PRIOR = 0.5
LEAST_Z = 3.0
DRIFT = 0.5
SIGNIFICANT = 0.01
EULER = 0.5772156649015329


@dataclass
class Model:
    scores: dict = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 1.0
    offset: float = -3.0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def held_out(id_column: Column) -> Column:
    """Rows that are never learnt from; a null id is not one of them."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score): Ruzzo and Tompa's scan.

    Only runs of positive scores can begin or end a segment, so the scan visits those;
    what lies between them counts through the running sum.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at end
    smaller: list[int] = []  # of each kept segment, the nearest earlier one with a smaller sum before it
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = float(sums[start]), float(sums[end])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                # What a link passes over has no smaller sum either; no later search sees it again.
                j = smaller[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                smaller.append(j)
                break
            start, left, after = kept[j][0], kept[j][2], smaller[j]
            del kept[j:], smaller[j:]
            j = after
    return [(s, e, r - x) for s, e, x, r in kept]


def evidence(text: str, model: Model) -> tuple[float, float, int, list[tuple[int, int, float]]]:
    """Summed surprise of significant segments, the largest segment, tokens, the significant segments."""
    words = tokens(text)
    get, neutral = model.scores.get, -DRIFT
    scores = np.array([get(w, neutral) for w in words])
    found = segments(scores)
    space = max(1.0, model.k * len(words))
    surprise, largest, passages = 0.0, 0.0, []
    for start, end, score in found:
        largest = max(largest, score)
        expected = space * math.exp(-model.rate * score)
        p = -math.expm1(-expected)
        if p <= SIGNIFICANT:
            surprise += -math.log(max(p, 1e-300))
            passages.append((start, end, score))
    return surprise, largest, len(words), passages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((w, toxic) for w in set(tokens(text)))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["token", "toxic", "n"],
        )


def _gather(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [evidence(t, model)[:3] for t in batch.column(0).to_pylist()]
            columns = [pa.array(c) for c in zip(*rows)] or [pa.array([], pa.float64())] * 2 + [pa.array([], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["surprise", "largest", "n", "toxic"])

    return run


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1."""
    p = weights / weights.sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(0.05, min(low, 5.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's steps with a little shrinkage."""
    a, b = 0.0, 0.0
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ [a, b], -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * np.array([a, b])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="toxic") -> Model:
    """Model from at most SAMPLE labelled rows outside the held-out fold.

    Labels without id or value are left out; of several labels of one id the largest
    counts. Without labels of both kinds the model scores every text alike.
    """
    with small_batches(docs.sparkSession):
        return _fitted(docs, labels, id_column, text_column, label_column)


def _fitted(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> Model:
    known = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("toxic"))
        .dropna().filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    # At most SAMPLE rows of two numbers: a proven bound for the broadcast.
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    rows = written(rows.join(known, "id").select("text", "toxic"))
    counts = rows.mapInArrow(_count, "token string, toxic int, n long").groupBy("token").agg(
        F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n")
    )
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total.n or not total.bad or total.bad == total.n:
        return Model(offset=-1.0)
    prior = F.col("n") * (PRIOR / total.n) + LEAST_PRIOR
    bad, good = F.col("bad") + prior, F.col("n") - F.col("bad") + prior
    odds = lambda c, all_: F.log(c / (F.lit(float(all_) + PRIOR) - c))
    delta = odds(bad, total.bad) - odds(good, total.n - total.bad)
    scored = counts.withColumns({"delta": delta, "z": delta / F.sqrt(1 / bad + 1 / good)}).filter(F.abs("z") >= LEAST_Z)
    top = scored.orderBy(F.abs("z").desc(), "token").limit(VOCABULARY).collect()
    model = Model({r.token: r.delta - DRIFT for r in top})
    clean = {r.token: r.n - r.bad for r in top}
    weights = np.array([*clean.values(), max(1, total.n - total.bad - sum(clean.values()))], float)
    model.rate = _decay(np.array([*model.scores.values(), -DRIFT]), weights)
    gathered = "surprise double, largest double, n long, toxic int"
    first = rows.mapInArrow(_gather(model), gathered).filter("toxic = 0 and n > 0").agg(
        F.avg(model.rate * F.col("largest") - F.log("n")).alias("mode")
    ).first()
    model.k = math.exp(min(5.0, max(-12.0, (first.mode if first.mode is not None else EULER) - EULER)))
    # At most SAMPLE pairs of numbers.
    pairs = rows.mapInArrow(_gather(model), gathered).select("surprise", "toxic").collect()
    x, y = np.array([p.surprise for p in pairs]), np.array([float(p.toxic > 0) for p in pairs])
    model.slope, model.offset = _logistic(np.log1p(x), y)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = [], []
            for cell in batch.column(batch.num_columns - 1):
                surprise, _, _, passages = evidence(cell.as_py(), model)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * math.log1p(surprise) + model.offset)))))
                counts.append(len(passages))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                [*batch.schema.names[:-1], "score", "n_passages"],
            )

    return run


def score(docs: DataFrame, model: Model, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, row, score, n_passages, predicted for every row; null and empty texts score as texts without passages."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, row long, score double, n_passages long").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def _filter(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for cell in batch.column(1):
                surprise = evidence(cell.as_py() or "", model)[0]
                keep.append(model.slope * math.log1p(surprise) + model.offset < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc"]).filter(pa.array(keep, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: Model, text_column="text") -> DataFrame:
    """The rows of docs that the model does not call toxic, with all their columns."""
    boxes = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_column).cast("string").alias("text"))
    return boxes.mapInArrow(_filter(model), T.StructType([boxes.schema["doc"]])).select("doc.*")
