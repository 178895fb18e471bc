"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, n string, found string, size string"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n, size=6):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, size))) for _ in range(n)]


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source), with columns that clash with inner names."""
    full = []
    for r in rows:
        doc_id, text, source = (*r, "web")[:3] if len(r) < 3 else r
        full.append((doc_id, text, None, source, None if text is None else len(text), "r", "i", "n", "f", "s"))
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Null, empty and blank texts, a null id, repeated rows, an id with two texts, a very long text."""
    rng = random.Random(5)
    same = " ".join(words(rng, 120))
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, same), (4, same), (4, same), (5, same + " x"), (5, "short text"),
        (6, " ".join(words(rng, 30_000))), (7, "ä" * 500), (8, "one"), (9, "a b c"), (10, None, None),
    ]


class Bag:
    """Links between nodes, and the smallest node each can reach."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def link(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
