"""Runs: maximal stretches of words that repeat with a period, found through Lyndon roots.

Every run holds a Lyndon root, a word sequence of one period that is smaller than all its
rotations, under the order of the words or under the reversed one, and that root is the
longest Lyndon sequence from its place on. So the longest Lyndon sequence from each place
under both orders, two arrays, gives all candidates.

Grouping. The first phase of Baier's suffix sorter gives such an array directly. Suffixes
are grouped by their first word; groups are taken from the highest down, and each is
appended to the nearest earlier suffixes of lower groups, which move to new groups right
above their old one. When all are done, the common prefix of a group is the longest
Lyndon prefix of its suffixes.

Roots. A root that follows itself is extended to the right and left by comparing words, the
longest common extensions of both copies; each run is extended once under each order.

Sieve. A run of length l >= max(shortest, times * q) with q <= l / times repeats windows of
words: of two equal windows at distance q there are l - q + 1 - w. So all its words lie in
windows of w = least(l - q) words that the text has twice, and grouping looks at maximal
stretches of such words only; nothing outside them can belong to a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.text import grams, table, text_of, word_hashes

SHORTEST = 24
TIMES = 3

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon sequence from each place on, by grouping suffixes."""
    n = len(symbols)
    length, before = [1] * n, [-1] * n
    members: list[list[int]] = []
    group_of, known = [0] * n, {}
    for symbol in sorted(set(symbols)):
        known[symbol] = len(members)
        members.append([])
    for i, symbol in enumerate(symbols):
        g = group_of[i] = known[symbol]
        members[g].append(i)
    done = [False] * n
    # Groups in order, as a list linked both ways.
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1:] = [-1]
    group = len(members) - 1
    while group >= 0:
        own = [i for i in members[group] if group_of[i] == group]
        members[group] = []
        # Earlier suffixes of lower groups, each with how often this group follows it at a stretch.
        longer: list[list[int]] = []
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            if p >= 0 and group_of[p] == group:
                p = before[p]
            before[i] = p
            if p >= 0:
                if longer and longer[-1][0] == p:
                    longer[-1][1] += 1
                else:
                    longer.append([p, 1])
        if own:
            size = length[own[0]]
            for i in own:
                done[i] = True
            if longer:
                fresh: dict[tuple[int, int], list[int]] = {}
                for p, times in longer:
                    length[p] += times * size
                    fresh.setdefault((group_of[p], times), []).append(p)
                # What is followed more often is higher; each lands right above the old group.
                for old, times in sorted(fresh, key=lambda k: -k[1]) if len(fresh) > 1 else fresh:
                    new, moved = len(members), fresh[old, times]
                    members.append(moved)
                    for p in moved:
                        group_of[p] = new
                    over = above[old]
                    below.append(old)
                    above.append(over)
                    above[old] = new
                    if over >= 0:
                        below[over] = new
        group = below[group]
    return length


def runs_of(symbols: list[int], shortest: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of the sequence that are long enough."""
    n, top, found = len(symbols), max(symbols, default=0), set()
    for own in (symbols, [top - s for s in symbols]):
        root = np.array(lyndon_array(own), np.int64)
        at = np.arange(n)
        # A run of three periods has two whole roots side by side.
        follower = at + root
        inside = follower < n
        starts = at[inside][root[follower[inside]] == root[inside]]
        ends: dict[int, int] = {}
        for i, q in zip(starts.tolist(), root[starts].tolist()):
            if i + 2 * q <= ends.get(q, 0):
                continue
            right = i + q
            while right < n and symbols[right] == symbols[right - q]:
                right += 1
            if right - i < 2 * q:
                continue
            left = i
            while left > 0 and symbols[left - 1] == symbols[left - 1 + q]:
                left -= 1
            ends[q] = right
            if right - left >= max(shortest, times * q):
                found.add((left, right - left, q))
    return found


def stretches(words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal ranges of words that lie in windows which occur twice in the text."""
    if len(words) <= window:
        return []
    windows = grams(words, window)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(covered) > 0, [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def text_runs(words: list[bytes], hashes: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period; times is 3 or more."""
    # The least of max(shortest, times * q) - q over all periods q.
    window = min(max(shortest, times * q) - q for q in range(1, shortest + 1))
    found = []
    for low, high in stretches(hashes, window):
        ranks: dict[bytes, int] = {}
        symbols = [ranks.setdefault(w, len(ranks)) for w in words[low:high]]
        found += [(low + s, n, q) for s, n, q in runs_of(symbols, shortest, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~dropped).tolist()]


def _row(run: tuple[int, int, int]) -> dict[str, int]:
    return dict(zip(("start", "length", "period"), run))


def _collapsed(shortest: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(1):
                text = cell.as_py().encode()
                words = text.split()
                found = text_runs(words, word_hashes(text, lower=False), shortest, times)
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                collapsed = b" ".join(kept_words(words, found)).decode()
                out.append((len(words), [_row(r) for r in found], _row(best) if best else None, collapsed))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.list_(_RUN), _RUN, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "runs", "best", "collapsed"]
            )

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, n_words, runs, best, collapsed for every row, in the one pass that reads it.

    runs are by start, then period. best is the run with the greatest length / period; of
    equals the first, then the one of the smallest period; null without runs. collapsed are
    the words outside of repetitions, joined by one blank. Null, empty and blank texts have
    no words and no runs. Repeated rows and null ids are rows like others; other columns
    are ignored; no rows give no rows. A text is held by one task, whatever its length.
    """
    if times < 3 or shortest < 2:
        raise ValueError("runs are sought from three periods and two words on")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(_collapsed(shortest, times), FOUND)


def repeated_from(words: list[bytes], number: int) -> list[bytes]:
    """The words, from a place that the number names on repeated with a period that it names."""
    n, g = len(words), number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = cell.as_py()
            number = zlib.crc32(str(doc).encode()) if doc is not None else 1
            if number % 10 == 0 and (words := text.encode().split()):
                text = b" ".join(repeated_from(words, number)).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents; every tenth id, by checksum, has its tail made periodic first. A null id has not."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    found = periodic_runs(docs.mapInArrow(_planted, "doc_id long, text string"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
