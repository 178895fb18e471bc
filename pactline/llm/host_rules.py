"""Host-level quality rules.

Rule failures are counted per host; a host's failure rate is shrunk towards the rate
of all hosts by a beta prior whose parameters are fitted to the hosts' rates (method
of moments); the host's verdict is joined back to its documents. A document is kept
if it passes the base rules itself and its host's shrunk rate is not above the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.store import written
from pactline.llm.text import WORD, table, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A host goes if more than this share of its documents fails, after shrinking.
MAX_FAILURE_RATE = 0.5

MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the list.

    Equal windows get equal numbers exactly, by doubling: numbers of runs of 1, 2, 4
    and 8 words are numbers of pairs of numbers of shorter runs.
    """
    if len(words) <= window or len(set(words)) == len(words):
        return 0
    ids: dict[str, int] = {}
    runs = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = 1
    while size < window:
        _, runs = np.unique(runs[:-size] * (len(words) + 1) + runs[size:], return_inverse=True)
        if int(runs.max()) + 1 == len(runs):
            return 0
        size *= 2
    again = np.bincount(runs)[runs] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for cell in batch.column(2):
            text = cell.as_py()
            words = WORD.findall(text)
            rows.append((len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(words)))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *columns],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def host_rules(docs: DataFrame, id_column="doc_id", text_column="text", host_column="source", max_rate=MAX_FAILURE_RATE) -> DataFrame:
    """Measures, base verdict, host rate and final verdict of every row.

    Null and empty texts have no words and so fail. A null host is a host of its own.
    Repeated rows count each. Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(host_column).cast("string").alias("host"), text_of(text_column).alias("text"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    measured = written(rows.mapInArrow(_measure, MEASURES).withColumn("base_failed", base))
    # Sums per host and task before the shuffle: a hot host is one row per task.
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    # Method of moments over the hosts' rates: mean, and the variance beyond that of sampling.
    prior = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.avg((F.col("failed") / F.col("n"))).alias("rate"),
        F.coalesce(F.var_samp(F.col("failed") / F.col("n")), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n")).alias("thin"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("spread") - noise * F.col("thin"), noise * F.lit(1e-3), F.lit(1e-9))
    prior = prior.select("mean", F.greatest(noise / between - 1, F.lit(1.0)).alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    # One row of prior beside the hosts: a scalar, not a product of two tables.
    verdicts = hosts.join(F.broadcast(prior)).select(F.col("host").alias("_host"), shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_kept"))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_host", "host_kept")


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate")
    )


OP6_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select rid, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word,
    generate_subscripts(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) as i from d
), g as (
  select rid, i, case when lead(word, 7) over o is not null then concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o,
    lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o, lead(word, 6) over o, lead(word, 7) over o) end as gram
  from w window o as (partition by rid order by i)
), c as (select rid, i, gram is not null and count(*) over (partition by rid, gram) > 1 as again from g),
r as (select rid, count(*) filter (hit) as n_repeat_words from (
  select rid, bool_or(again) over (partition by rid order by i rows between 7 preceding and current row) as hit from c) group by rid),
l as (
  select rid, count(*) - count(distinct line) as n_dup_lines from (select rid, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), n as (select rid, count(*) as n_words, sum(length(word)) as word_chars from w group by rid),
m as (
  select doc_id, source, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join n using (rid) left join l using (rid) left join r using (rid)
), b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
h as (select source, count(*) as n, count(*) filter (base_failed) as failed from b group by source),
p as (
  select sum(failed) / sum(n) as mean, coalesce(var_samp(failed / n), 0) as spread, avg(1 / n) as thin from h
), s as (
  select mean, greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * thin, mean * (1 - mean) * 1e-3, 1e-9) - 1, 1) as strength from p
), v as (select source, (failed + mean * strength) / (n + strength) as host_rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_rate <= 0.5 as kept, round(host_rate, 9) as host_rate
from b left join v on b.source is not distinct from v.source
"""
