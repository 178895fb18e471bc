"""Exact substring removal against every string of every text."""

import hashlib
import random
from collections import Counter

import pytest

from llm.data import docs, odd_rows, words
from pactline.llm import suffix_dedup as sd


def expected(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length):
    frame = sd.remove_repeats(docs(spark, rows), length).drop("kept_text")
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def planted():
    rng = random.Random(3)
    passage, near = " ".join(words(rng, 40)), " ".join(words(rng, 14))
    rows = [(i, " ".join([*words(rng, 30), passage[rng.randint(0, 60) :], *words(rng, 20)])) for i in range(12)]
    # Just short of, just as long as, and just longer than the length, in different company.
    rows += [(20 + i, " ".join(words(rng, 25)) + "#" + (near * 9)[: 62 + i % 5] + "#" + " ".join(words(rng, 9))) for i in range(15)]
    rows += [(50, "a" * 300), (51, "ab" * 90), (52, "ü" * 70 + "x"), (53, rows[0][1]), (54, rows[0][1] + "!"), (55, passage + " " + passage)]
    return rows


@pytest.mark.parametrize("crowd", [1, 4096])
def test_equals_every_string(spark, monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    rows = planted()
    assert found(spark, rows, 64) == expected(rows, 64)


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(spark, rows, 400) == expected(rows, 400)
    assert found(spark, [], 400) == []


def test_kept_text_is_what_is_left(spark):
    rows = [(1, "x" * 10 + "é" * 200), (2, "é" * 200 + "y")]
    kept = {r.doc_id: r.kept_text for r in sd.remove_repeats(docs(spark, rows), 400).collect()}
    assert kept == {1: "x" * 10, 2: "y"}


def test_deep_shallow_order_is_sorted_order():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(200)) + b"abc" * 80 + b"z" * 90
    for length, shallow in ((40, 8), (40, 64), (13, 8)):
        suffixes = list(range(len(data) - length))
        rng.shuffle(suffixes)
        groups = list(sd.suffix_order(suffixes, data, length, shallow))
        keys = [{data[s : s + length] for s in g} for g in groups]
        assert all(len(k) == 1 for k in keys)
        order = [k.pop() for k in keys]
        assert order == sorted({data[s : s + length] for s in suffixes})
        assert sorted(s for g in groups for s in g) == sorted(suffixes)


def test_every_string_has_an_anchor_fixed_by_its_bytes():
    import numpy as np

    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)) + b"q" * 200, np.uint8)
    anchor, first, last = sd.anchors(data, 80)
    assert first[0] == 0 and last[-1] == len(data) - 80 and (first[1:] == last[:-1] + 1).all()
    offsets = {}
    for a, f, e in zip(anchor, first, last):
        for p in range(f, e + 1):
            assert p <= a <= p + 80 - sd.GRAM
            assert offsets.setdefault(data[p : p + 80].tobytes(), a - p) == a - p
