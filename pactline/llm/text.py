"""Words, shingles and polynomial digests of texts, computed with numpy inside tasks.

A word is a run of anything but blank, tab, line feed, vertical tab, form feed and
carriage return. Separators and A-Z are ASCII, so UTF-8 bytes can be cut and lowered
byte by byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1
#: Bytes of a batch that are worked on at once, unless one row has more.
SLICE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For bytes.translate: A-Z in lower case.
LOWER_BYTES = _LOWER.tobytes()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1B54A32D192ED03
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes, so that what is made of them is bounded as well."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1 << 16, 2 * n)
            steps = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_powers = _Powers()


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.concatenate(([True], _SEPARATOR[data], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


class Digests:
    """64-bit digests of any slice of one byte string, in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = _powers.to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def runs(self, start: int, count: int, size: int) -> np.ndarray:
        """Digests of the slices of size bytes at count neighbouring starts."""
        sums = self._sums[start : start + count + size]
        return mix((sums[size : size + count] - sums[:count]) * self._down[start : start + count])


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word of a UTF-8 text, in order."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data)
    return Digests(data).of(starts, ends)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; one hash of the whole run where there are fewer, none of none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i])
    return out


class Runs:
    """64-bit hashes of all runs of any number of words, in the same time for each number."""

    def __init__(self, words: np.ndarray) -> None:
        up, self._down = _powers.to(len(words) + 1)
        self._sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self._sums[1:])

    def of(self, k: int) -> np.ndarray:
        n = max(0, len(self._sums) - k)
        return mix((self._sums[k:] - self._sums[:n]) * self._down[:n])

    def around(self, places: np.ndarray, k: int, reach: int) -> np.ndarray:
        """Hashes of the runs of k words at places with up to reach words before and after them."""
        low, high = np.maximum(places - reach, 0), np.minimum(places + k + reach, len(self._sums) - 1)
        return mix((self._sums[high] - self._sums[low]) * self._down[low] + (places - low).astype(np.uint64))


def row_hash(id_column: Column, text_column: Column) -> Column:
    """Tells rows of one id with different texts apart; rows that agree in both are alike."""
    return F.xxhash64(id_column, text_column)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without leaving the JVM."""
    parts = F.split(text, r"[\x20\x09-\x0D]+", -1)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
