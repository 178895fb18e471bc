"""Revisit resolution against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from pactline.llm import revisits as rv

RECORD = "record_id long, url string, ts double, kind string, etag string, last_modified string, headers map<string,string>, payload string, address string, found string"


@pytest.mark.parametrize(
    "url, address",
    [
        ("HTTP://WWW.Example.com:80/A/b/?utm_source=x&b=2&a=1#top", "example.com/A/b?a=1&b=2"), ("https://example.com/", "example.com"),
        ("https://example.com:8080", "example.com:8080"), (" example.com/x?ref=1 ", "example.com/x"), ("http://e.com/x?reference=1&", "e.com/x?reference=1"), ("", ""),
    ],
)
def test_canonical(spark, url, address):
    assert spark.createDataFrame([(url,)], "u string").select(rv.canonical(F.col("u"))).first()[0] == address


def plain(records):
    out = {}
    for r in (r for r in records if r[3] == "revisit"):
        before = [] if r[1] is None or r[2] is None else [s for s in records if s[3] == "response" and s[1] == r[1] and s[2] is not None and s[2] < r[2]]
        if not before:
            out[r[0]] = (None, "missing", None)
            continue
        s = max(before, key=lambda s: (s[2], s[0]))
        tags = (r[4] or "").removeprefix("W/") == (s[4] or "").removeprefix("W/") if r[4] and s[4] else None
        same = tags if tags is not None else (r[5] == s[5] if r[5] and s[5] else None)
        status = {None: "unchecked", True: "resolved", False: "mismatch"}[same]
        headers = None
        if status != "mismatch":
            headers = {**s[6], **{k: v for k, v in (r[6] or {}).items() if k in rv.UPDATES and v is not None}}
        out[r[0]] = (s[0], status, headers)
    return out


def test_equals_plain_search(spark):
    rng = random.Random(1)
    records = []
    for i in range(600):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        url = rng.choice(["hot.com/a"] * 6 + ["b.com", "c.com/x", None])
        ts = rng.choice([None, *map(float, range(1, 60))])
        headers = {"etag": "1", "content-length": str(i), "date": str(i)} if kind != "revisit" else rng.choice([None, {}, {"date": "new", "content-length": "0", "vary": None}])
        records.append((i, url, ts, kind, rng.choice([None, "1", "W/1", "2"]), rng.choice([None, "d1", "d2"]), headers, f"p{i}", "x", "y"))
    got = {r.record_id: (r.response_id, r.status, r.headers) for r in rv.resolve(spark.createDataFrame(records, RECORD)).collect()}
    assert got == plain(records)


def test_empty_and_payload(spark):
    assert rv.resolve(spark.createDataFrame([], RECORD)).count() == 0
    rows = [(1, "a.com", 1.0, "response", "1", None, {"x": "y"}, "body" * 50_000, "", ""), (2, "http://a.com/", 2.0, "revisit", "1", None, None, None, "", "")]
    r = rv.resolve(spark.createDataFrame(rows, RECORD)).first()
    assert (r.status, len(r.payload), r.headers) == ("resolved", 200_000, {"x": "y"})


def test_repeated_records_count_once(spark):
    """Equal rows, equal ids with other contents, ids that are null."""
    response, revisit = (1, "a.com", 1.0, "response", "1", None, {"x": "y"}, "body", "", ""), (2, "a.com", 2.0, "revisit", "1", None, {"etag": "1"}, None, "", "")
    rows = [response] * 2 + [revisit] * 2 + [(2, "z.com", 9.0, "revisit", "1", None, None, None, "", ""), (1, "a.com", 1.0, "response", "1", None, {"x": "z"}, "body", "", "")]
    rows += [(None, "a.com", 3.0, "revisit", "1", None, None, None, "", "")] * 2
    got = {r.record_id: (r.response_id, r.status, r.headers, r.payload) for r in rv.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    assert len(got) == 2 == rv.resolve(spark.createDataFrame(rows, RECORD)).count()
    assert got[2] == (1, "resolved", {"x": "y", "etag": "1"}, "body") and got[None][:2] == (1, "resolved")


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "a.com", "x"), (3, "", ""), (3, "", "")], "page_id long, url string, html string")
    got = rv.resolve(rv.captures(pages)).filter("record_id is not null").collect()
    assert sorted(r.record_id for r in got) == [8, 9, 11, 12, 25, 26, 28, 29]
    assert {r.status for r in got if r.record_id < 16} == {"missing"}
    assert {r.record_id: (r.response_id, r.status) for r in got if r.record_id > 16} == {
        25: (24, "mismatch"), 26: (24, "mismatch"), 28: (27, "resolved"), 29: (27, "mismatch")
    }


def test_the_query_has_every_verdict_and_several_responses(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a{i % 40}.com/", f"text {i}") for i in range(200)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    records = [tuple(r) for r in rv.captures(pages).collect()]
    # Not only the last response of an address is right.
    got = {r.record_id: (r.response_id, r.status) for r in rv.op7_revisits(spark, str(tmp_path)).collect()}
    address = lambda r: (r[0], r[1].removeprefix("http://").removesuffix("/"), *r[2:])
    assert got == {k: v[:2] for k, v in plain([address(r) for r in records]).items()}
    assert {s for _, s in got.values()} == {"resolved", "mismatch", "unchecked", "missing"}
