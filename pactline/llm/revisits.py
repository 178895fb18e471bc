"""Not-modified revisits of web archives, resolved to the response they stand for.

An as-of join by canonical address: each revisit gets the latest full response
strictly before it, if their validators agree, and the response's headers with those
a 304 answer may bring replaced. Addresses may be hot, so the join is two-level: the
latest response of each (address, slice of time), carried over the slices, and inside
a slice the last one seen. Payloads do not travel; they are joined by record at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.mixing import slice_bits
from pactline.llm.store import sieved, written
from pactline.llm.text import table

#: Headers of a 304 answer that update a stored response.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that do not select content.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Address without scheme, "www.", default port, fragment, tracking parameters and closing slashes; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(bare, "^[^?]*[?](.*)$", 1), "&", -1)
    query = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """record_id, address, response_id, status, headers, payload for every revisit.

    records has record_id, url, ts, kind ("response" or "revisit"), etag,
    last_modified, headers (map of strings, names in lower case) and payload. status is
    "resolved"; "mismatch" if both sides have an entity tag, or else a date, and they
    differ; "unchecked" if they have no validator in common; "missing" without an
    earlier response or with a null url or time. Only resolved and unchecked revisits
    get headers and payload. Of responses at one time the largest id is the latest.
    Records of one id are one, however often they come; of different ones that with the
    smallest values stands. Records of other kinds are ignored, so are other columns. No rows give no rows.
    """
    light = written(records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical(F.col("url")).alias("address"), F.col("ts").cast("double").alias("ts"),
        (F.col("kind") == "response").cast("int").alias("full"), "etag", "last_modified",
    ))
    # Ids that come again are few; only their rows are gathered.
    again = written(light.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("record_id"))

    def once(rows: DataFrame, key: str, order: Column) -> DataFrame:
        repeated = rows[key].eqNullSafe(again["record_id"])
        rest = [c for c in rows.columns if c != key]
        least = rows.join(again, repeated, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("least"))
        return rows.join(again, repeated, "left_anti").unionByName(least.select(key, "least.*"))

    light = once(light, "record_id", F.struct("address", "ts", "full", "etag", "last_modified"))
    usable = light.filter("address is not null and ts is not null")
    span = usable.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    slices = 1 << slice_bits(span.n)
    width = max(((span.high or 0.0) - (span.low or 0.0)) / slices, 1e-9)
    cut = usable.withColumn("slice", F.floor((F.col("ts") - (span.low or 0.0)) / width).cast("long"))
    response = F.struct("ts", "record_id", "etag", "last_modified")
    latest = cut.groupBy("address", "slice").agg(F.max(F.when(F.col("full") == 1, response)).alias("here"))
    before = W.partitionBy("address").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = latest.select("address", "slice", F.last("here", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("address", "slice").orderBy("ts", "full", "record_id").rowsBetween(W.unboundedPreceding, 0)
    found = cut.join(carried, ["address", "slice"]).withColumn(
        "found", F.coalesce(F.last(F.when(F.col("full") == 1, response), ignorenulls=True).over(inside), "carried")
    ).filter("full = 0").select("record_id", "address", "etag", "last_modified", "found")
    lost = light.filter("full = 0 and (address is null or ts is null)").select("record_id", "address", "etag", "last_modified")
    found = found.unionByName(lost, allowMissingColumns=True)
    same_tag = F.regexp_replace("etag", "^W/", "") == F.regexp_replace("found.etag", "^W/", "")
    verdict = F.coalesce(same_tag, F.col("last_modified") == F.col("found.last_modified"))
    status = (
        F.when(F.col("found").isNull(), "missing").when(verdict.isNull(), "unchecked").when(verdict, "resolved").otherwise("mismatch")
    )
    usable_id = F.when(F.col("status").isin("resolved", "unchecked"), F.col("response_id"))
    judged = found.select("record_id", "address", F.col("found.record_id").alias("response_id"), status.alias("status"))
    judged = written(judged.withColumn("_from", usable_id))
    own = records.filter("kind = 'revisit'").select(F.col("record_id").alias("_revisit"), F.col("headers").alias("_new"))
    stored = records.filter("kind = 'response'").select(F.col("record_id").cast("long").alias("_response"), F.col("headers").alias("_old"), "payload")
    # Responses that no revisit stands for stay where they are.
    stored, _ = sieved(stored, judged.filter("_from is not null").select(F.col("_from").alias("_response")), "_response")
    own = once(own, "_revisit", F.to_json("_new"))
    stored = once(stored, "_response", F.to_json(F.struct("_old", "payload")))
    full = judged.join(stored, F.col("_from") == F.col("_response"), "left").join(own, F.col("record_id") == F.col("_revisit"), "left")
    brought = F.map_filter(F.coalesce("_new", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*UPDATES) & v.isNotNull())
    kept = F.map_filter(F.coalesce("_old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(brought), k))
    headers = F.when(F.col("_response").isNotNull(), F.map_concat(kept, brought))
    return full.select("record_id", "address", "response_id", "status", headers.alias("headers"), "payload")


#: Captures of a page by the query, and how far they are apart.
ROUNDS = 6
LAG = 100.5


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl that came to each page ROUNDS times; by rule some captures are full responses, of two versions.

    Of every third capture on there is a full response; the others are revisits, so some
    come before any response and some after one of the other version. Entity tags name
    the version; every fifth page has dates only, and revisits of every seventh nothing.
    """
    id_, k = F.col("page_id").cast("long"), F.col("k").cast("long")
    full = F.pmod(id_ + k, F.lit(3)) == 0
    version = F.pmod(F.floor((id_ + k) / 2).cast("long"), F.lit(2))
    body = F.concat(F.coalesce("html", F.lit("")), F.lit("#"), version)
    bare = ~full & (id_ % 7 == 0)
    tag = F.when(~bare & (id_ % 5 != 0), F.concat(F.lit('"'), F.md5(body), F.lit('"')))
    dated = F.when(~bare & (id_ % 5 == 0), F.concat(F.lit("v"), version))
    rows = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("k"))
    given = {
        "content-length": F.when(full, F.octet_length(body)).otherwise(0).cast("string"),
        "date": (id_ * 10 + k).cast("string"),
        "cache-control": F.when(~full, "max-age=60"),
        "etag": tag,
    }
    headers = F.map_filter(F.create_map(*[x for n, v in given.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return rows.select(
        (id_ * 8 + k).alias("record_id"), "url", (id_ + k * F.lit(LAG)).alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
        tag.alias("etag"), dated.alias("last_modified"), headers.alias("headers"), F.when(full, body).alias("payload"),
    )


def op7_revisits(spark, sf_dir: str) -> DataFrame:
    done = resolve(captures(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.select("record_id", "address", "response_id", "status", listed.alias("headers"), F.md5("payload").alias("payload_md5"))


OP7_SQL = r"""
with b as (
  select page_id::bigint as id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages
), c as (
  select id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&'),
      lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sid|sessionid)(=|$)'))), '&') as query
  from b
), r as (
  select 8 * id + k as record_id, place || case when query <> '' then '?' || query else '' end as address, id + k * 100.5 as ts,
    (id + k) % 3 = 0 as whole, coalesce(html, '') || '#' || ((id + k) // 2) % 2 as body, id, k, ((id + k) // 2) % 2 as version,
    (id + k) % 3 <> 0 and id % 7 = 0 as naked
  from c, generate_series(0, 5) g(k)
), v as (
  select *, case when not naked and id % 5 <> 0 then '"' || md5(body) || '"' end as tag,
    case when not naked and id % 5 = 0 then 'v' || version end as dated from r
), w as (select address, ts, max(record_id) as record_id from v where whole group by address, ts),
j as (
  select n.record_id, n.address, n.id, n.k, n.tag, n.dated, o.record_id as response_id, o.tag as old_tag, o.dated as old_dated, o.body, o.id as old_id, o.k as old_k
  from (select * from v where not whole) n asof left join w on n.address = w.address and n.ts > w.ts left join v o on o.record_id = w.record_id
), s as (
  select *, case when response_id is null then 'missing' when coalesce(tag = old_tag, dated = old_dated) is null then 'unchecked'
    when coalesce(tag = old_tag, dated = old_dated) then 'resolved' else 'mismatch' end as status from j
)
select record_id, address, response_id, status,
  case when status in ('resolved', 'unchecked') then 'cache-control=max-age=60;content-length=' || strlen(body) || ';date=' || (10 * id + k)
    || case when coalesce(tag, old_tag) is not null then ';etag=' || coalesce(tag, old_tag) else '' end end as headers,
  case when status in ('resolved', 'unchecked') then md5(body) end as payload_md5
from s
"""
