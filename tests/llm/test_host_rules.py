"""Host rules against naive counting."""

import random
from collections import Counter

from llm.data import docs, odd_rows, words

from pactline.llm import host_rules as hr
from pactline.llm.text import WORD


def naive_repeats(w, size=8):
    runs = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    hit = {i + j for i in range(len(w) - size + 1) if runs[tuple(w[i : i + size])] > 1 for j in range(size)}
    return len(hit)


def test_repeated_words_equal_counting():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            w = words(rng, 15) * 2 + w
        assert hr.repeated_words(w) == naive_repeats(w)


def test_duplicate_lines():
    assert hr.duplicate_lines("a\nb\na\n\n \n \na") == 2 and hr.duplicate_lines("") == 0


def test_measures_and_verdicts(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(words(rng, 40)), "good") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(30)]
    rows += [(200 + i, " ".join(words(rng, 30)), "bad") for i in range(3)] + [(300, " ".join(words(rng, 30)), "new"), (301, "x", None)]
    rows += [(302, "é# * $$\n" + " ".join(words(rng, 25)), None)]
    got = {r.doc_id: r for r in hr.host_rules(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t, s in rows:
        w = WORD.findall(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert r.base_failed == (len(w) < 20 or 100 * naive_repeats(w) > 30 * len(w))
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    assert all(got[i].kept for i in range(60)) and not any(got[200 + i].kept for i in range(3))
    # A host of one document is judged by what is known of all hosts.
    rates = {r.host: r.host_rate for r in got.values()}
    assert rates["good"] < rates["new"] < rates["bad"] and got[300].kept


def test_odd_rows(spark):
    rows = odd_rows()
    got = hr.host_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.kept is not None and r.host_rate is not None for r in got)
    assert hr.host_rules(docs(spark, [])).collect() == []
