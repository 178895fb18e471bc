"""Exact substring removal with a sparse suffix array, sorted deep-shallow.

Every byte covered by a `length`-byte string that also starts elsewhere is removed.

Anchors. Each string of `length` bytes is given an anchor: the position of the
smallest hash among its runs of GRAM bytes, the rightmost of equals. Equal strings
have their anchors at equal offsets, so only strings of equal anchors need comparing.
Neighbouring strings share anchors: an anchor owns a range of strings, and its
context, the bytes these strings cover, is some 550 bytes.

Buckets. Anchors whose run of GRAM bytes is found once are done. Contexts found
twice repeat as a whole, as inside copies. What is left are contexts that agree
around the anchor and differ further out: the ends of repeated passages. They are cut
by offset into cells of CELL strings, and only cells whose common bytes (length - CELL
+ 1 of them) occur again are sorted.

Sorting. The suffixes of a bucket's cells are ordered by multikey quicksort on
eight-byte characters to SHALLOW bytes; groups that still agree, with long common
prefixes as a rule, are ordered by blind tries. Neighbours in the order that agree in
`length` bytes are repeats.

Digests are counted with partial sums before each shuffle, so a passage in a third of
all documents is no hot task; only bytes of distinct contexts meet in a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.store import sieved, written
from pactline.llm.text import Digests, mix, row_hash, table, text_of

LENGTH = 400
GRAM = 32
CELL = 16
SHALLOW = 64
#: Cells of one key that are sorted in one task; beyond it the key's strings are counted by digest.
CROWD = 4096
#: Positions looked at in one go, so that a very long text takes no more memory than a short one.
STRETCH = 1 << 19

_LOW = 20


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor and the range of string starts that it owns."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    digests = Digests(data)
    found = []
    for base in range(0, n, STRETCH):
        count = min(STRETCH, n - base)
        width = length - GRAM + 1
        hashes = digests.runs(base, count + width - 1, GRAM)
        # Of equal hashes the rightmost is least: its place, counted down, is in the low bits.
        least = (hashes & ~np.uint64((1 << _LOW) - 1)) | (np.uint64((1 << _LOW) - 1) - np.arange(len(hashes), dtype=np.uint64))
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        found.append(base + (np.uint64((1 << _LOW) - 1) - (least & np.uint64((1 << _LOW) - 1))).astype(np.int64))
    owner = np.concatenate(found)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], n) - 1
    return owner[first], first, last


def _pack(anchor, first, last):
    return (first << 24) | ((anchor - first) << 12) | (last - first)


def _unpack(packed: int) -> tuple[int, int, int]:
    first = packed >> 24
    return first + ((packed >> 12) & 0xFFF), first, first + (packed & 0xFFF)


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "gram", "context", "place"]
        for batch in batches:
            docs, rows, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, cell in enumerate(batch.column(2)):
                data = np.frombuffer(cell.as_py().encode(), np.uint8)
                anchor, first, last = anchors(data, length)
                if len(anchor):
                    digests = Digests(data)
                    gram = digests.of(anchor, anchor + GRAM)
                    # The context with the anchor's offset in it, and how many strings it has.
                    context = mix(digests.of(first, last + length) + ((anchor - first) * 4096 + last - first).astype(np.uint64))
                    parts.append((np.full(len(anchor), i), gram.view(np.int64), context.view(np.int64), _pack(anchor, first, last)))
            which, gram, context, place = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
            keys = [pa.array(docs, pa.int64()).take(pa.array(which)), pa.array(rows, pa.int64()).take(pa.array(which))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(gram), pa.array(context), pa.array(place)], names)

    return run


def _contexts(length: int):
    """Bytes of the contexts asked for in a text: (gram, context, doc_id, row, place, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, asked, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = cell.as_py().encode()
                for p in asked:
                    _, first, last = _unpack(p["place"])
                    out.append((doc, row, p["gram"], p["place"], data[first : last + length]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()])], ["doc_id", "row", "gram", "place", "bytes"]
            )

    return run


def _cells(length: int):
    """Cells of a context: digest of the bytes that all strings at these offsets have, and where the cell's own bytes are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, place, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = cell.as_py()
                anchor, first, last = _unpack(place)
                # Offsets of the anchor in the strings: from anchor - last to anchor - first.
                for c in range((anchor - last) // CELL, (anchor - first) // CELL + 1):
                    low, high = max(anchor - last, c * CELL), min(anchor - first, c * CELL + CELL - 1)
                    start = anchor - c * CELL - first
                    common = data[max(0, start) : start - CELL + 1 + length]
                    key = hashlib.blake2b(common, digest_size=15).digest() + bytes([c])
                    out.append((key, doc, row, place, anchor - high, high - low + length))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.binary(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["key", "doc_id", "row", "place", "start", "size"])

    return run


def multikey_quicksort(suffixes: list[int], data: bytes, depth: int, shallow: int, length: int) -> Iterator[tuple[list[int], int]]:
    """Groups of suffixes that agree in their first bytes, in order, with how many these are.

    One character is eight bytes. A group of one, or at the shallow depth, is final.
    """
    stack = [(suffixes, depth)]
    while stack:
        group, at = stack.pop()
        if len(group) < 2 or at >= min(shallow, length):
            yield group, at
            continue
        keys = [data[s + at : s + min(at + 8, length)] for s in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, same, more = [], [], []
        for s, key in zip(group, keys):
            (same if key == pivot else less if key < pivot else more).append(s)
        stack += [(g, d) for g, d in ((more, at), (same, at + 8), (less, at)) if g]


class BlindTrie:
    """Suffixes ordered by a trie whose branches store only a depth and one byte each.

    A suffix is first led down blindly by the bytes at branching depths, then compared
    once with the leaf it reached; where they part it is put in.
    """

    __slots__ = ("data", "length", "root")

    def __init__(self, data: bytes, length: int) -> None:
        self.data, self.length, self.root = data, length, None

    def common(self, a: int, b: int, start: int) -> int:
        """Bytes that two suffixes have in common, knowing that `start` bytes agree."""
        x, y = self.data[a : a + self.length], self.data[b : b + self.length]
        if x == y:
            return self.length
        low, high = start, self.length
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if x[: middle + 1] == y[: middle + 1] else (low, middle)
        return low

    def add(self, suffix: int, start: int = 0) -> None:
        if self.root is None:
            self.root = [self.length, [suffix]]
            return
        node, path = self.root, []
        while node[0] < self.length:
            path.append(node)
            branch = self.data[suffix + node[0]]
            node = node[1].get(branch) or next(iter(node[1].values()))
        depth = self.common(suffix, node[1][0], start)
        if depth == self.length:
            node[1].append(suffix)
            return
        # The first node on the path that lies deeper than the parting.
        node, parent = self.root, None
        while node[0] < depth:
            parent, node = node, node[1].get(self.data[suffix + node[0]])
            if node is None:
                parent[1][self.data[suffix + parent[0]]] = [self.length, [suffix]]
                return
        if node[0] == depth:
            node[1][self.data[suffix + depth]] = [self.length, [suffix]]
            return
        there = node
        while there[0] < self.length:
            there = next(iter(there[1].values()))
        fork = [depth, {self.data[there[1][0] + depth]: node, self.data[suffix + depth]: [self.length, [suffix]]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][self.data[suffix + parent[0]]] = fork

    def groups(self) -> Iterator[list[int]]:
        """Suffixes in order, those that agree in `length` bytes together."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.length:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def suffix_order(suffixes: list[int], data: bytes, length: int, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Suffixes in the order of their first `length` bytes, equal ones in one list: deep-shallow sorting."""
    for group, depth in multikey_quicksort(suffixes, data, 0, shallow, length):
        if len(group) == 1 or depth >= length:
            yield group
            continue
        trie = BlindTrie(data, length)
        for suffix in group:
            trie.add(suffix, depth)
        yield from trie.groups()


def _sorted_cells(length: int):
    """Repeated strings of the cells of each key; rows must come with equal keys together."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, cells in groupby(rows(batches), key=lambda r: r[0]):
            cells = list(cells)
            if len(cells) > 1:
                pieces, owner, suffixes, at = [], {}, [], 0
                for _, doc, row, start, data in cells:
                    for s in range(len(data) - length + 1):
                        suffixes.append(at + s)
                        owner[at + s] = (doc, row, start + s)
                    pieces.append(data)
                    at += len(data)
                for group in suffix_order(suffixes, b"".join(pieces), length):
                    if len(group) > 1:
                        out += [owner[s] for s in group]
            if len(out) > 20_000:
                yield _ranges(out)
                out = []
        yield _ranges(out)

    return run


def _ranges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Runs of neighbouring string starts: (doc_id, row, first, last)."""
    merged = []
    for doc, row, start in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])):
        if merged and merged[-1][:2] == [doc, row] and start <= merged[-1][3] + 1:
            merged[-1][3] = start
        else:
            merged.append([doc, row, start, start])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*merged)] or [pa.array([], pa.int64())] * 4, ["doc_id", "row", "first", "last"])


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row, first, last: starts of all strings of rows (doc_id, row, text) that start elsewhere too."""
    spots = written(rows.mapInArrow(_anchored(length), "doc_id long, row long, gram long, context long, place long"))
    grams = spots.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    again = written(spots.join(grams.filter("n > 1").drop("n"), "gram"))
    first = F.shiftright("place", 24)
    whole = lambda f: f.select("doc_id", "row", first.alias("first"), (first + F.col("place").bitwiseAND(0xFFF)).alias("last"))
    alike, mixed = again.filter("low = high"), again.filter("low <> high")
    contexts = written(
        mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("at"))
    )
    inside = mixed.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    # One place of each distinct context; all places of one document: bounded by its length.
    asked = contexts.select("at.*", "gram").groupBy("doc_id", "row").agg(F.collect_list(F.struct("gram", "place")).alias("asked"))
    asked = written(asked)
    a, t = asked.alias("a"), sieved(rows, asked)[0].alias("t")
    same = F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.row") == F.col("t.row"))
    bytes_of = t.join(a, same).select("t.doc_id", "t.row", "asked", "text").mapInArrow(
        _contexts(length), "doc_id long, row long, gram long, place long, bytes binary"
    )
    kept = written(bytes_of)
    cells = written(kept.select("doc_id", "row", "place", "bytes").mapInArrow(
        _cells(length), "key binary, doc_id long, row long, place long, start long, size long"
    ))
    shared = written(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))

    def with_bytes(keys: DataFrame) -> DataFrame:
        c, k = cells.join(keys.select("key"), "key", "left_semi").alias("c"), kept.alias("k")
        there = F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.row") == F.col("k.row")) & (F.col("c.place") == F.col("k.place"))
        own = F.substring("bytes", (F.col("c.start") - F.shiftright("c.place", 24) + 1).cast("int"), F.col("c.size").cast("int"))
        return c.join(k, there).select("key", "c.doc_id", "c.row", "c.start", own.alias("bytes"))

    ends = with_bytes(shared.filter(F.col("n") <= CROWD)).repartition("key").sortWithinPartitions("key").mapInArrow(
        _sorted_cells(length), "doc_id long, row long, first long, last long"
    )
    # Crowded keys, of passages just short of `length`, would gather in one task: count their strings one by one.
    strings = with_bytes(shared.filter(F.col("n") > CROWD)).select(
        "doc_id", "row", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bytes") - length + 1), lambda i: F.sha2(F.substring("bytes", i, length), 256))).alias("nth", "string"), "start"
    )
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    at = F.col("start") + F.col("nth")
    crowded = strings.join(twice, "string", "left_semi").select("doc_id", "row", at.alias("first"), at.alias("last"))
    ends = ends.unionByName(crowded)
    return whole(alike).unionByName(whole(inside)).unionByName(ends)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = cell.as_py().encode()
                kept, upto, removed, spans = [], 0, 0, 0
                for p in sorted(found or [], key=lambda p: p["first"]):
                    start, end = p["first"], p["last"] + length
                    if start > upto or not spans:
                        kept.append(data[upto:start])
                        spans += 1
                        removed += end - start
                        upto = end
                    elif end > upto:
                        removed += end - upto
                        upto = end
                kept.append(data[upto:])
                rest = b"".join(kept)
                out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row.

    Null and empty texts have no bytes. Texts shorter than `length` stay whole. Rows
    that agree repeat each other. kept_text leaves out bytes of characters cut in two.
    Other columns are ignored. No rows give no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias("row"), "text")
    # Ranges of one document: bounded by its length.
    found = written(
        repeated_ranges(rows, length).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    )
    maybe, rest = sieved(rows, found)
    r, f = maybe.alias("r"), found.alias("f")
    joined = r.join(f, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.row") == F.col("f.row")), "left").select("r.doc_id", "text", "found")
    whole = rest.select("doc_id", "text", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("found"))
    return joined.unionByName(whole).mapInArrow(
        _removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
