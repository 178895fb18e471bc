"""Benchmark decontamination: training passages query a BM25 index of the test items.

Test items are indexed in blocks of at most BLOCK items, so that the index a task
holds is bounded whatever their number; every block meets all documents. A document
is cut into overlapping passages, and each passage retrieves all items whose BM25
score reaches MIN_SCORE of what the item scores against itself. Scores are divided by
that self-score, which makes one threshold serve all items.

Block-max WAND: posting lists are cut into ranges of PER_RANGE items with the largest
weight in each. A passage first adds up its terms' range maxima, for all passages and
ranges of a document at once; only ranges that can reach the threshold are walked,
list by list, and items before a pivot are skipped unscored.

All retrieved passages of a pair are verified, up to the first that holds: the item's
shingles, question and answer each, that occur in the passage's surroundings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.store import boxed, sieved, written
from pactline.llm.text import WORD, row_hash, table, text_of

K1, B = 1.2, 0.75
MIN_SCORE = 0.6
SHINGLE = 5
MIN_OVERLAP = 0.8
BLOCK = 2_000
PER_RANGE = 4
HALVES = 256
#: Block maxima are 32-bit numbers; a bound within this of the threshold counts as reaching it.
SLACK = 1e-4
MAX_ITEM_BYTES = 64 << 20


def lowered(text: str) -> list[str]:
    """Words with A-Z lowered."""
    return WORD.findall(text.encode().lower().decode())


def question_and_answer(words: list[str]) -> tuple[list[str], list[str]]:
    """The first sentence asks, the rest answers; an item of one sentence has no answer."""
    for i, word in enumerate(words[:-1]):
        if word[-1] in ".?!":
            return words[: i + 1], words[i + 1 :]
    return words, []


def shingles(words: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of k words; the whole run where there are fewer."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def contained(part: list[str], text: list[str], k: int = SHINGLE) -> float:
    """Share of the shingles of part that text has too; 1 of none."""
    k = min(k, len(part))
    own = shingles(part, k)
    return len(own & shingles(text, k)) / len(own) if own else 1.0


class Index:
    """Inverted index of one block of test items, with impacts relative to self-scores.

    Items are numbered; ranges of PER_RANGE numbers are the blocks of all posting lists.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float) -> None:
        self.ids = [i for i, _ in items]
        self.words = [lowered(t) for _, t in items]
        self.terms: dict[str, int] = {}
        self.lists: list[dict[int, list[tuple[int, float]]]] = []
        for at, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
            impact = {
                w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm)
                for w, n in Counter(words).items()
            }
            own = sum(impact.values())
            for w, x in impact.items():
                term = self.terms.setdefault(w, len(self.terms))
                if term == len(self.lists):
                    self.lists.append({})
                self.lists[term].setdefault(at // PER_RANGE, []).append((at, x / own))
        self.most = np.zeros((len(self.lists), -(-len(items) // PER_RANGE)), np.float32)
        for term, ranges in enumerate(self.lists):
            for r, postings in ranges.items():
                self.most[term, r] = max(x for _, x in postings)
        self.longest = max(map(len, self.words), default=0)

    def walk(self, terms: list[int], r: int, least: float) -> list[tuple[int, float]]:
        """All items of range r whose score with these distinct terms is at least `least`, by WAND over the range."""
        lists = [(self.lists[t][r], float(self.most[t, r])) for t in terms if r in self.lists[t]]
        cursors = sorted([p[0][0], 0, most, p] for p, most in lists)
        found = []
        while cursors:
            # Lists in order of their next item; the pivot is where their maxima first reach the threshold.
            bound, pivot = 0.0, None
            for at, cursor in enumerate(cursors):
                bound += cursor[2]
                if bound >= least - SLACK:
                    pivot = at
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(c[3][c[1]][1] for c in cursors if c[0] == item)
                if score >= least - 1e-12:
                    found.append((item, score))
                item += 1
            for cursor in cursors:
                while cursor[1] < len(cursor[3]) and cursor[3][cursor[1]][0] < item:
                    cursor[1] += 1
                cursor[0] = cursor[3][cursor[1]][0] if cursor[1] < len(cursor[3]) else -1
            cursors = sorted(c for c in cursors if c[0] >= 0)
        return found

    def hits(self, words: list[str], least: float) -> Iterator[tuple[int, float, int]]:
        """(item, score, the passage's first word) of every item that a passage of the text reaches.

        A passage is two neighbouring halves of at least an item's length, so any
        stretch of that length lies whole in a passage. Its block maxima are added up
        for all ranges at once; only ranges that can reach the threshold are walked.
        """
        half = max(self.longest, 8)
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at) or not len(self.lists):
            return
        n = len(self.lists)
        keys = np.unique((at // half) * n + ids[at])
        place, terms = keys // n, keys % n
        halves, begin = np.unique(place, return_index=True)
        ends = np.append(begin[1:], len(keys))
        for first in range(0, len(halves), HALVES):
            # One half more than are scored from here, so that every pair of neighbours is seen.
            last = min(len(halves), first + HALVES + 1)
            sums = np.add.reduceat(self.most[terms[begin[first] : ends[last - 1]]], begin[first:last] - begin[first], axis=0)
            follows = halves[first:last][1:] == halves[first:last][:-1] + 1
            sums[:-1][follows] += sums[1:][follows]
            for h, r in np.argwhere(sums[:HALVES] >= least - SLACK).tolist():
                h += first
                upto = ends[h + 1] if h + 1 < len(halves) and halves[h + 1] == halves[h] + 1 else ends[h]
                for item, score in self.walk(np.unique(terms[begin[h] : upto]).tolist(), r, least):
                    yield item, score, int(halves[h]) * half

    def retrieve(self, words: list[str], least: float) -> dict[int, tuple[float, int]]:
        """Every item that a passage of the text reaches, with its best score and the first word of the first such passage."""
        best: dict[int, tuple[float, int]] = {}
        for item, score, start in self.hits(words, least):
            if item not in best or score > best[item][0]:
                best[item] = (score, start)
        return best


def matches(words: list[str], index: Index, least: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """(item, best score, question overlap, answer overlap) of the items that a text contains.

    Every passage that reaches an item may hold it, whatever the others score: they are
    verified from the best on, up to the first that does.
    """
    out = []
    size = 2 * max(index.longest, 8)
    reached: dict[int, list[tuple[float, int]]] = {}
    for item, score, start in index.hits(words, least):
        reached.setdefault(item, []).append((-score, start))
    for item, passages in sorted(reached.items()):
        passages.sort()
        parts = question_and_answer(index.words[item])
        for _, start in passages:
            near = words[max(0, start - size) : start + 2 * size]
            shares = [contained(part, near) for part in parts]
            if min(shares) >= overlap or contained(index.words[item], near) >= overlap:
                out.append((index.ids[item], -passages[0][0], *shares))
                break
    return out


def _query(indexes: list[Index], least: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = lowered(cell.as_py())
                out += [(doc, row, *m) for index in indexes for m in matches(words, index, least, overlap)]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "row", "item_id", "score", "question_overlap", "answer_overlap"]
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_column="doc_id", text_column="text", least=MIN_SCORE, overlap=MIN_OVERLAP, block=BLOCK) -> DataFrame:
    """doc_id, row, item_id, score and overlaps of every verified pair.

    Null and empty texts and items match nothing; repeated items count once each by
    id, items without an id like others; repeated rows give their pairs again. Other columns are ignored. Without
    items or rows there are no pairs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    known = items.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").alias("text")).dropDuplicates()
    known = known.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # Document frequencies over all items, so that scores do not depend on the blocks.
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = known.select("item_id", "text", F.filter(F.split(low, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"))
    mean = parts.agg(F.avg(F.size("words"))).first()[0] or 0.0
    frequency = parts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    schema = "doc_id long, row long, item_id long, score double, question_overlap double, answer_overlap double"
    blocks = max(1, math.ceil(max(stats.n / block, stats.bytes / MAX_ITEM_BYTES)))
    numbered = parts.select("item_id", "text", "words", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        mine = numbered.filter(F.col("block") == number)
        here = [(r.item_id, r.text) for r in mine.select("item_id", "text").collect()]
        if here:
            terms = mine.select(F.explode("words").alias("word")).distinct()
            df = {r.word: r.df for r in frequency.join(terms, "word", "left_semi").collect()}
            index = Index(sorted(here, key=lambda item: (item[0] is None, item[0] or 0, item[1])), df, stats.n, mean)
            found = rows.mapInArrow(_query([index], least, overlap), schema)
            # Written before the next is built: the driver holds one index at a time.
            out = out.union(written(found) if blocks > 1 else found)
    return out


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 9).alias("score"), "question_overlap", "answer_overlap")


def without_contaminated(docs: DataFrame, items: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """docs less those that contain a test item."""
    found = written(contaminated(docs, items, id_column, text_column).select("doc_id", "row").distinct())
    key = F.col(id_column).cast("long")
    maybe, rest = sieved(boxed(docs, key, row_hash(key, text_of(text_column))), found)
    same = maybe["doc_id"].eqNullSafe(found["doc_id"]) & (maybe["row"] == found["row"])
    return rest.select("doc.*").unionByName(maybe.join(found, same, "left_anti").select("doc.*"))
