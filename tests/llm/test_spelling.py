import random
import re
import zlib
from collections import Counter

import pytest

from pactline.llm import spelling
from llm.data import docs, odd_rows


def one_edit(a, b):
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def brute_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_groups(counts):
    form, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        top = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if near and counts[top] >= 5 * n else None
        out[w] = (w, n, len(near), form[w], counts[form[w]] if form[w] else None)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(*row, root(w)) for w, row in out.items()}


def variants(rng, word, letters="abcdefghéß"):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def texts(rng):
    base = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    bag = []
    for w in base:
        bag += [w] * rng.choice([5, 26, 130, 700])
        v = w
        for _ in range(4):
            v = variants(rng, v)
            bag += [v] * rng.choice([4, 5, 6, 25, 130])
    # Chains of forms, each step one edit and five times as frequent.
    for c in "bcdefg":
        bag += [w for i, n in enumerate((5, 27, 140, 720)) for w in [c * 3 + "hhhhhh" + "ß" * i] * n]
    rng.shuffle(bag)
    # Ties, anagrams, repeated letters at the border of the halves, letters on both sides of the class's ends.
    bag += ["aaabbb"] * 30 + ["aaaabbb"] * 6 + ["aaabbbb"] * 150 + ["zzzzzzz"] * 5 + ["zzzzzzy"] * 25 + ["zzzzzzx"] * 25
    bag += ["Àbcdefÿ"] * 9 + ["ÀBCDEFÿ"] * 9 + ["bcdefÀÿ"] * 9 + ["ab×cdef÷"] * 8 + ["Ābcdefg"] * 8
    return [(i, rng.choice([" ", ", ", "1"]).join(bag[i::90])) for i in range(90)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts(random.Random(4)) + odd_rows() + [(None, "nullid " * 7), (90, "w" * 40_000 + " " + ("v" * 300 + " ") * 6 + ("v" * 299 + " ") * 31)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spelling.op13_spelling_groups(spark, str(tmp_path)).collect()}
    expected = brute_groups(brute_counts(rows))
    assert got == expected
    chains = [r for r in expected if r[3] and r[3] != r[5]]
    assert len(chains) > 5 and any("é" in r[0] for r in expected)


def test_slips_of_every_document(spark):
    rows = [(i, "wordsare spelled likethis") for i in range(15_000)]
    expected = brute_counts(rows)
    assert len(expected) > 15 and dict(map(tuple, spelling.word_counts(docs(spark, rows), slips=True).collect())) == expected


def test_counts_in_small_parts(spark, monkeypatch):
    rows = texts(random.Random(5))
    counts = spelling.word_counts(docs(spark, rows), slips=True)
    monkeypatch.setattr(spelling, "HELD", 3)
    assert dict(map(tuple, counts.collect())) == brute_counts(rows)


@pytest.mark.parametrize("parts", [3, 5, 8])
def test_pairs_share_a_signature(parts):
    rng = random.Random(parts)
    signatures = spelling.Signatures(parts)
    for _ in range(1500):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 12)))
        b = variants(rng, a)
        if a != b:
            x, y = signatures.of([a, b])
            assert set(x.tolist()) & set(y.tolist())


def test_long_chain_and_no_words(spark):
    words = [("a" * (10 + i), 6**i) for i in range(9)]
    out = {r["word"]: r for r in spelling.spelling_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for r in out.values()} == {"a" * 18} and out["a" * 18]["form"] is None
    empty = spelling.spelling_groups(spelling.word_counts(docs(spark, [(1, None), (2, "short only")])))
    assert empty.collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(spelling.word_counts(docs(spark, [])), times=1)
