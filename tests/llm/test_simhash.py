import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from pactline.llm import simhash
from pactline.llm.text import WORD
from llm.data import Bag, docs, odd_rows, words


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = WORD.findall(lower)
    size = min(3, len(own))
    hashes = [xxhash.xxh64(" ".join(own[i : i + size]).encode(), seed=42).intdigest() for i in range(len(own) - size + 1)] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    bag, distinct = Bag(set(marks)), sorted(set(marks))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                bag.link(a, b)
    return bag


def near(rng, mark, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        mark ^= 1 << b
    return mark


def signed(mark):
    return mark - (1 << 64) if mark >> 63 else mark


@pytest.mark.parametrize("bits", [1, 3, 5, 7])
def test_every_near_pair_has_a_chain_and_a_key(bits):
    rng = random.Random(bits)
    masks = simhash.key_masks(bits)
    for _ in range(3000):
        x = near(rng, 0, bits)
        fits = [
            s for s in range(8)
            if all((x & simhash._ring(s, n)).bit_count() <= allowed for n, allowed in enumerate(simhash.budgets(bits), 1))
        ]
        assert fits and all(any(s == start and not x & m for start, m in masks) for s in fits)


@pytest.mark.parametrize("crowd", [2, 16])
def test_pairs_equal_brute_force(spark, monkeypatch, crowd):
    """Groups of near marks, as dense as 3 or 14 bits allow: keys are split several times."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(7)
    marks = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        marks |= {near(rng, centre, 6) for _ in range(60)}
    centre, free = rng.getrandbits(64), rng.sample(range(64), 9)
    marks |= {centre ^ sum(1 << b for b in free if rng.random() < 0.5) for _ in range(150)}
    marks = sorted(signed(m) for m in marks)
    out = simhash.near_pairs(spark.createDataFrame([(m,) for m in marks], "mark long"))
    got = [tuple(r) for r in out.collect()]
    array = np.array(marks, np.int64)
    expected = {
        (a, b) for i, a in enumerate(marks) for b in array[i + 1 :][np.bitwise_count((array[i + 1 :] ^ a).view(np.uint64)) <= 3].tolist()
    }
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 500


def copies(rng):
    base = [words(rng, 60) for _ in range(12)]
    rows = list(enumerate((" ".join(b) for b in base), 100))
    for i in range(140):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = "x"
        rows.append((200 + i, rng.choice([" ", "  ", "\n"]).join(text).upper() if i % 3 else " ".join(text)))
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for r in odd_rows() if r[0] != 6] + copies(rng)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op12_simhash_components(spark, str(tmp_path)).collect()
    marks = [brute_fingerprint(r[1]) for r in rows]
    bag = brute_components(marks)
    least = {}
    for (doc_id, *_), mark in zip(rows, marks):
        if doc_id is not None:
            least[bag.root(mark)] = min(doc_id, least.get(bag.root(mark), doc_id))
    expected = [Row(doc_id=r[0], fingerprint=f"{m:016x}", component_id=least[bag.root(m)]) for r, m in zip(rows, marks)]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    sizes = [sum(bag.root(m) == root for m in marks) for root in {bag.root(m) for m in marks}]
    assert max(sizes) > 5 and len(set(marks)) > len(sizes)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3, 10)} == {"0" * 16}


def test_very_long_text_in_stretches(monkeypatch):
    text = " ".join(words(random.Random(3), 3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text) == whole == signed(brute_fingerprint(text))


def test_one_text_in_most_rows_and_no_rows(spark):
    rng = random.Random(2)
    rows = [(i, "all of these are the same words") for i in range(500, 2500)] + [(i, " ".join(words(rng, 50))) for i in range(40)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert len(out) == 2040 and all(out[i] == (500 if i >= 500 else i) for i in out)
    assert simhash.simhash_components(docs(spark, [])).collect() == []
    assert simhash.simhash_components(docs(spark, [(None, "a b c d")])).first()["component_id"] is None
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([], "mark long"), 8)
