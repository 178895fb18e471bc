"""From raw documents to a training mix: STAGES in order, each on all that the one before kept.

All but the last return the columns of documents. run() writes each stage to the
shared folder and reads it again for the next. Stages that hand texts to Python set the
session's bytes of an Arrow batch (store.BATCH_BYTES): whoever writes what they return needs them small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from pactline.llm.store import keep_batches_small, written
from pactline.llm.text import table


def no_toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not call toxic."""
    keep_batches_small(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, 5, 80)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    keep_batches_small(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credentials replaced by their kind."""
    keep_batches_small(spark)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words the mix takes of each."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", no_toxic_texts),
    ("near_copies", one_of_near_copies),
    ("decontamination", no_test_items),
    ("secrets", no_secrets),
    ("mixing", mixed),
]

#: Segment scores, BM25 walks and span positions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
