"""BM25 walk against full scoring, and planted items."""

import math
import random
from collections import Counter, defaultdict

from llm.data import docs, odd_rows, words

from pactline.llm import decontaminate as dc


def items_and_index(rng, n=60):
    vocabulary = words(rng, 150)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) + ".") for i in range(n)]
    df = Counter(w for _, t in items for w in set(dc.lowered(t)))
    mean = sum(len(dc.lowered(t)) for _, t in items) / n
    return vocabulary, items, dc.Index(items, df, n, mean), df, mean


def test_walk_equals_full_scoring():
    rng = random.Random(3)
    vocabulary, items, index, df, mean = items_and_index(rng)
    weight = defaultdict(dict)
    for at, (_, text) in enumerate(items):
        w = dc.lowered(text)
        norm = dc.K1 * (1 - dc.B + dc.B * len(w) / mean)
        own = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * c * (dc.K1 + 1) / (c + norm) for x, c in Counter(w).items()}
        for x, v in own.items():
            weight[x][at] = v / sum(own.values())
    for _ in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        least, half = rng.choice([0.1, 0.25, 0.4]), max(index.longest, 8)
        best = {}
        for start in range(0, len(text), half):
            score = Counter()
            for x in set(text[start : start + 2 * half]):
                for at, v in weight[x].items():
                    score[at] += v
            for at, v in score.items():
                if v >= least:
                    best[at] = max(best.get(at, 0), v)
        got = index.retrieve(text, least)
        assert {a: round(v, 5) for a, v in best.items()} == {a: round(v, 5) for a, (v, _) in got.items()}


def test_planted_items(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 12)) + "? " + " ".join(words(rng, 9)) + ".") for i in range(30)]
    rows, expected = [], set()
    for d in range(80):
        text = words(rng, rng.randint(5, 300))
        if d % 4 == 0:
            item, at = items[d % 30], rng.randrange(len(text))
            text[at:at] = item[1].upper().split() if d % 8 else item[1].split()
            expected.add((d, item[0]))
        if d % 4 == 1:  # the question alone is no leak
            text[2:2] = items[d % 30][1].split()[:6]
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame([*items, items[0], (90, None), (91, ""), (None, " ")], "item_id long, text string")
    for block in (2000, 7):
        got = dc.contaminated(docs(spark, rows), frame, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    kept = {r.doc_id for r in dc.without_contaminated(docs(spark, rows), frame).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in expected}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "short text"), (2, "a b c"), (3, "unseen words here now")], "item_id long, text string")
    got = dc.contaminated(docs(spark, odd_rows()), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(5, 1), (9, 2)]
    assert dc.contaminated(docs(spark, []), items).count() == 0
    assert dc.contaminated(docs(spark, odd_rows()), items.limit(0)).count() == 0
    assert dc.without_contaminated(docs(spark, odd_rows()), items.limit(0)).count() == len(odd_rows())


def test_a_copy_behind_a_passage_of_the_same_words_in_other_order(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 12)) + "? " + " ".join(words(rng, 9)) + ".") for i in range(6)]
    rows = []
    for d, (_, text) in enumerate(items):
        mixed = text.split()
        rng.shuffle(mixed)
        copy = text.split() if d % 2 else []
        rows.append((d, " ".join([*words(rng, 40), *mixed, *words(rng, 600), *mixed, *words(rng, 600), *copy, *words(rng, 30)])))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (2000, 2):
        got = dc.contaminated(docs(spark, rows), frame, block=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (3, 3), (5, 5)]


def test_items_without_an_id(spark):
    rng = random.Random(6)
    items = [(None, " ".join(words(rng, 30))), (3, " ".join(words(rng, 30))), (None, " ".join(words(rng, 30))), (None, None)]
    rows = [(1, "start " + items[0][1]), (2, items[1][1]), (3, items[2][1] + " end"), (4, " ".join(words(rng, 60)))]
    out = dc.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, None), (2, 3), (3, None)}
