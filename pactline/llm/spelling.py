"""Spelling variants: rare words one edit away from much more frequent ones.

Words one edit apart have multisets of letters that, as binary vectors over (letter,
occurrence), differ in at most two places. PartEnum deals the dimensions into PARTS parts and
enumerates the ways to leave two of them out: in one of these the vectors agree, so equal
signatures find all such pairs. One edit also leaves one half of a word as it was, the first
or the second, and that half is put into the signature, which would be shared by all
anagrams otherwise. What meets is verified by its edit distance.

Words are counted per task before they are shuffled; only distinct words are joined.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.store import written
from pactline.llm.text import LOWER_BYTES, mix, table, text_of

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 6
RAREST = 5
TIMES = 5
PARTS = 5
#: Words that a task counts before it hands them on.
HELD = 1 << 18
#: Every word of a document whose checksum this divides has a letter left out in the query.
SLIP = 199

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def slipped(word: str, checksum: int) -> str:
    """The word, or without one letter where the checksum says so."""
    if checksum % SLIP:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def _counted(shortest: int, slips: bool):
    # Shorter runs of letters are no words, with or without a slip.
    pattern = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def table_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(pattern.findall(cell.as_py().encode().translate(LOWER_BYTES).decode()))
                if slips:
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), head) % SLIP == 0]:
                        n = own.pop(word)
                        word = slipped(word, zlib.crc32(word.encode(), head))
                        if len(word) >= shortest:
                            counts[word] += n
                counts.update(own)
                if len(counts) > HELD:
                    yield table_of(counts)
                    counts = Counter()
        yield table_of(counts)

    return run


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, slips: bool = False, id_column="doc_id", text_column="text") -> DataFrame:
    """word, n: all words of `shortest` letters and `rarest` occurrences. Null and empty texts have none."""
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text_of(text_column).alias("text"))
    counts = rows.mapInArrow(_counted(shortest, slips), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def _spread(value: int) -> int:
    """One number as text.mix spreads arrays of them."""
    value = (value ^ (value >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    value = (value ^ (value >> 27)) * 0x94D049BB133111EB & _MASK
    return value ^ (value >> 31)


class Signatures:
    """PartEnum signatures of words, joined with the half that an edit leaves."""

    def __init__(self, parts: int = PARTS) -> None:
        self.parts = parts
        self.kept = [[p for p in range(parts) if p not in out] for out in combinations(range(parts), 2)]
        self._dimensions: dict[tuple[str, int], tuple[int, int]] = {}

    def dimension(self, letter: str, nth: int) -> tuple[int, int]:
        """(part, value) of one place of the binary vector."""
        key = letter, nth
        if key not in self._dimensions:
            value = _spread((ord(letter) << 32 | nth + 1) * _STEP & _MASK)
            self._dimensions[key] = value % self.parts, value
        return self._dimensions[key]

    def projections(self, word: str) -> list[int]:
        """For each part, the places of the word's vector in it, as one sum."""
        sums, seen = [0] * self.parts, {}
        for letter in word:
            nth = seen.get(letter, 0)
            seen[letter] = nth + 1
            part, value = self.dimension(letter, nth)
            sums[part] += value
        return [s & _MASK for s in sums]

    @staticmethod
    def halves(word: str) -> list[tuple[int, int, str]]:
        """What stays under one edit: either half, cut for the shorter word's length."""
        out = []
        for length in (len(word), len(word) - 1):
            half = length // 2
            out += [(length, 0, word[:half]), (length, 1, word[len(word) - length + half :])]
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """All signatures of the words, as rows of signed numbers."""
        sums = np.array([self.projections(w) for w in words], np.uint64).reshape(-1, self.parts)
        halves = np.array([[hash_of(h) for h in self.halves(w)] for w in words], np.uint64).reshape(-1, 4)
        columns = []
        with np.errstate(over="ignore"):
            for i, kept in enumerate(self.kept):
                value = np.full(len(words), i + 1, np.uint64)
                for p in kept:
                    value = mix(value * np.uint64(_STEP) + sums[:, p])
                columns += [mix(value * np.uint64(_STEP) + halves[:, h]) for h in range(4)]
        return np.stack(columns, axis=1).view(np.int64)


def hash_of(half: tuple[int, int, str]) -> int:
    length, side, letters = half
    data = letters.encode()
    return _spread((zlib.crc32(data) << 32 | zlib.crc32(data, 1)) + (length << 1 | side) * _STEP & _MASK)


def _signed_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(parts)
        for batch in batches:
            keys = signatures.of(batch.column(0).to_pylist())
            which = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(which), batch.column(1).take(which)], ["key", "word", "n"])

    return run


def near_words(counts: DataFrame, parts: int = PARTS) -> DataFrame:
    """a, a_n, b, b_n: all pairs of the distinct words (word, n) that are one edit apart, each once, a before b."""
    keyed = written(counts.select("word", "n").mapInArrow(_signed_words(parts), "key long, word string, n long"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    return a.join(b, near).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by doubling the steps of all chains at once."""
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        longer = written(steps.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_at").isNotNull().alias("_moved")))
        steps = longer.select("word", "root")
        if longer.filter("_moved").isEmpty():
            return steps


def spelling_groups(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of counts (word, n; each word once).

    form is the near word with the greatest n, of equals the first in code-point order, if
    its n is at least `times` the word's; times is above 1, so chains of forms end. No
    words give no rows.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its variants")
    counts = written(counts.select("word", "n"))
    near = written(near_words(counts))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top")
    ).select("word", "n_near", F.col("top.other").alias("other"), (-F.col("top.less")).alias("other_n"))
    likely = F.col("other_n") >= F.col("n") * times
    placed = written(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("other")).alias("form"), F.when(likely, F.col("other_n")).alias("form_n")
    ))
    ends = roots(placed.filter("form is not null"))
    return placed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_groups(spark, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a slip, each with its more frequent near word. A null id counts as an empty one."""
    counts = word_counts(table(spark, sf_dir, "documents"), slips=True)
    return spelling_groups(counts).select("word", "n", "n_near", "form", "form_n", "root")
