"""Secret scan against the plain patterns, and linking of weak parts."""

import hashlib
import re

from llm.data import docs, odd_rows
from pyspark.sql import functions as F

from pactline.llm import secrets

RANDOM = "q9XvT4mLz7RkP2wYb8NcJ5"


def plain(text):
    """The findings of the three patterns, each tried at every place."""
    out = []
    for rank, kind, pattern in (
        (0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        (1, "access", r"AKIA[A-Z0-9]+"), (2, "hex", r"[0-9a-f]+"),
    ):
        for m in re.compile(pattern, re.A).finditer(text):
            size = len(m.group(1)) if rank == 0 else len(m.group())
            if size >= (6, 20, 24)[rank]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


TEXTS = [
    'x password="hunter22" and API_KEY : abc', "ſecret=abcdefgh Secret=abcdefgh ToKeN='a.b-c=d/e'", "é AKIA" + "A7" * 8 + " AKIASHORT",
    "deadbeef" * 3 + " " + "0" * 23, "passwd==x12345 apikey=apikey=123456", "token: \n secret", f"key {RANDOM} alone",
    f"login to https://db.example.com/x with {RANDOM}", "see https://example.com only", "user: bob is here",
    f"user: bob\npassword=hunter22\n{RANDOM}", "AKIA" + "B" * 17 + " " + "pad " * 30 + RANDOM, "AKIA" + "B" * 17 + " " + "pad " * 100 + RANDOM,
]


def found(spark, rows):
    frame = secrets.scan(docs(spark, rows))
    return {r.doc_id: r for r in frame.withColumn("spans", secrets.spans_text(F.col("found"))).collect()}


def test_base_findings(spark):
    rows = list(enumerate(TEXTS))
    for d, r in found(spark, rows).items():
        expected = plain(TEXTS[d])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(expected.count(k) for k in ("assign:", "access:", "hex:"))
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))


def test_weak_parts_need_company(spark):
    kinds = {d: [x.split(":")[0] for x in r.spans.split(",") if x] for d, r in found(spark, list(enumerate(TEXTS))).items()}
    assert kinds[6] == kinds[8] == kinds[9] == []
    assert kinds[7] == ["endpoint", "weak_secret"]
    assert kinds[10] == ["weak_id", "assign", "weak_secret"]
    assert kinds[11] == ["access", "weak_secret"] and kinds[12] == ["access"]


def test_linking_across_bins(spark):
    for pad in (0, 480, 511, 1023):
        text = "." * pad + f" https://db.example.com/x {RANDOM} "
        assert [p["rank"] for p in found(spark, [(1, text)])[1].found] == [5, 3]


def test_odd_rows_and_redaction(spark):
    rows = [*odd_rows(), (20, TEXTS[0]), (20, TEXTS[0]), (21, TEXTS[7])]
    frame = secrets.scan(docs(spark, rows))
    assert frame.count() == len(rows) and frame.filter("found is null").count() == 0
    assert secrets.scan(docs(spark, [])).count() == 0
    clean = secrets.redact(docs(spark, rows))
    assert clean.columns == docs(spark, []).columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.filter("doc_id >= 20 or doc_id = 1").collect()}
    assert texts == {1: None, 20: 'x [ASSIGN]" and API_KEY : abc', 21: "login to [ENDPOINT] with [WEAK_SECRET]"}
