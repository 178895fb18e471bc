import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pactline.llm import periods
from pactline.llm.text import WORD, word_hashes
from llm.data import docs, odd_rows, words


def lyndon(s):
    """Longest Lyndon sequences straight from their definition."""
    return [max(e - i for e in range(i + 1, len(s) + 1) if all(s[i:e] < s[k:e] for k in range(i + 1, e))) for i in range(len(s))]


def brute_runs(s, shortest=24, times=3):
    out = []
    for q in range(1, len(s)):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            part = s[i : j + q]
            smaller = any(part[r:] == part[:-r] for r in range(1, q)) if j > i else False
            if j > i and len(part) >= max(shortest, times * q) and not smaller:
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def patched(rng, n, letters):
    """Random symbols with periodic stretches."""
    out = []
    while len(out) < n:
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        out += (unit * 40)[: rng.randint(1, 60)]
    return out[:n]


def test_grouping_gives_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 14))]
        assert periods.lyndon_array(s) == lyndon(s)


@pytest.mark.parametrize("shortest,times", [(24, 3), (2, 3), (9, 5)])
def test_runs_equal_brute_force(shortest, times):
    rng = random.Random(2)
    for _ in range(150):
        s = patched(rng, rng.randint(0, 120), rng.randint(1, 4))
        expected = brute_runs(s, shortest, times)
        assert sorted(periods.runs_of(s, shortest, times), key=lambda r: (r[0], r[2])) == expected
        texts = [b"w%d" % x for x in s]
        assert periods.text_runs(texts, word_hashes(b" ".join(texts), lower=False), shortest, times) == expected


def test_stretches_hold_all_windows_that_occur_twice():
    hashes = np.array([1, 2, 3, 4, 9, 1, 2, 3, 7, 8], np.uint64)
    assert periods.stretches(hashes, 3) == [(0, 3), (5, 8)]
    assert periods.stretches(hashes, 4) == []
    assert periods.stretches(hashes[:2], 3) == []


def expected_row(doc_id, text):
    own = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and own:
        n, g = len(own), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(own)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(own) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)),
    )


def query(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in periods.op11_periodic_runs(spark, str(tmp_path)).collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = odd_rows()[:8] + odd_rows()[9:]
    for i in range(100, 220):
        symbols = patched(rng, rng.randint(1, 150), 3) if i % 2 else [rng.randrange(500) for _ in range(rng.randint(1, 90))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(f"W{s}" if s % 2 else f"ü{s}" for s in symbols)))
    got = query(spark, tmp_path, rows)
    assert by_text(got) == by_text(expected_row(r[0], r[1]) for r in rows)
    assert sum(r[1] for r in got) > 40


def test_very_long_text_and_ties(spark):
    long = " ".join(words(random.Random(4), 300)) + " " + "a b c " * 30_000
    tie = "x y " * 15 + "- " + "u v " * 15
    out = {r["doc_id"]: r for r in periods.periodic_runs(docs(spark, [(1, long), (2, tie)])).collect()}
    assert [tuple(r) for r in out[1]["runs"]] == [(300, 90_000, 3)] and len(out[1]["collapsed"].split()) == 303
    assert [tuple(r) for r in out[2]["runs"]] == [(0, 30, 2), (31, 30, 2)] and tuple(out[2]["best"]) == (0, 30, 2)
    assert out[2]["collapsed"] == "x y - u v"


def test_no_rows_and_bad_parameters(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
    with pytest.raises(ValueError):
        periods.periodic_runs(docs(spark, []), times=2)
