"""Not-modified revisit resolution: each 304 capture finds the latest earlier full response of its canonical URL.

The as-of join sorts captures into range partitions of (URL, time), so a hot URL spans many of them. Inside a partition
a window carries the last response forward; what a partition hands on to later ones is one row per URL and partition.
Only ids, times and validators are sorted; headers and payload columns are joined once the response is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, parts_for, query, table

#: Header fields that a not-modified answer may update in the stored response (fixed by the HTTP standard).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that name where a reader came from, not the page.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes, query without tracking
    parameters and sorted; no scheme, no fragment. Null for a null URL."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), TRACKING, "")
    asked = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda x: x != "")), "&")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then clash, the last one counts. Null: no headers."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    kept = F.transform(F.array(entries), lambda all_: F.filter(
        all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later.key == e.key)
    ))[0]
    return F.coalesce(F.map_from_entries(kept), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers, with the permitted ones of the not-modified answer in their place."""
    fresh = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve_revisits(records: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per revisit of ``records(record_id, type, url, date, headers, *payload)``; type is response or revisit.

    Gives record_id, canonical_url, response_id, status, headers and the payload columns of the response. Among earlier
    responses (strictly earlier dates) of the same canonical URL the latest counts, of equal dates the larger
    record_id. Status: ``resolved`` if the validators agree (entity tags, weak marks aside, if both have one, else
    Last-Modified), ``mismatch`` if they differ, ``unchecked`` if no validator is on both sides, ``orphan`` without an
    earlier response, URL or date. Only resolved rows get the merged headers and the payload; others keep their own headers.
    Other types are ignored; repeated revisits are answered each; repeated response ids must be repeated rows.
    """
    scratch = Scratch(records.sparkSession, "revisit")
    records = records.where("type IN ('response', 'revisit')").select(
        "record_id", "type", canonical_url(F.col("url")).alias("canonical_url"), "date",
        lower_names(F.col("headers")).alias("headers"), *payload,
    )
    records = scratch.write(records)
    revisits = records.where("type = 'revisit'").select("record_id", "canonical_url", "date", F.col("headers").alias("own"))
    order = ["canonical_url", "date", "kind", "record_id"]  # a revisit stands before a response of its own date
    line = records.where("canonical_url IS NOT NULL AND date IS NOT NULL").select(
        "canonical_url", "date", F.when(F.col("type") == "revisit", 0).otherwise(1).alias("kind"), "record_id"
    ).distinct()
    line = scratch.write(
        line.repartitionByRange(parts_for(records.sparkSession), *order).withColumn("part", F.spark_partition_id())
    )
    response = F.when(F.col("kind") == 1, F.struct("date", "record_id"))
    before = Window.partitionBy("part", "canonical_url").orderBy("date", "kind", "record_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    seen = line.withColumn("near", F.last(response, ignorenulls=True).over(before)).where("kind = 0")
    handed = line.groupBy("canonical_url", "part").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).select("canonical_url", "part", "far")
    carried = scratch.write(carried.where("far IS NOT NULL"))
    found = scratch.write(
        seen.join(carried, ["canonical_url", "part"], "left")
        .select("record_id", "canonical_url", "date", F.coalesce("near.record_id", "far.record_id").alias("response_id"))
    )
    stored = records.where("type = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("stored"), *payload
    ).dropDuplicates(["response_id"])
    asked = scratch.write(revisits.join(found, ["record_id", "canonical_url", "date"], "left"))
    both = asked.join(stored, "response_id", "left")
    tag = lambda h: F.regexp_replace(h.getItem("etag"), "^W/", "")
    same_tag = tag(F.col("own")) == tag(F.col("stored"))
    same_time = F.col("own").getItem("last-modified") == F.col("stored").getItem("last-modified")
    agrees = F.coalesce(same_tag, same_time)
    status = (
        F.when(F.col("response_id").isNull(), "orphan").when(agrees.isNull(), "unchecked")
        .when(agrees, "resolved").otherwise("mismatch")
    )
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "canonical_url", "response_id", "status",
        F.when(ok, merge_headers(F.col("stored"), F.col("own"))).otherwise(F.col("own")).alias("headers"),
        *[F.when(ok, F.col(c)).alias(c) for c in payload],
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures from crawled pages: each page is a full response, and is asked for again once, with a not-modified answer.

    A page's time follows from its id, so captures of one canonical URL interleave. Every seventh answer names another
    entity tag, every fifth has no tag and relies on Last-Modified.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    at = n * 37 % 100_003
    day = lambda x: F.concat(F.lit("t"), x.cast("string"))
    size = F.length("html").cast("string")
    first = pages.select(
        (2 * n).alias("record_id"), F.lit("response").alias("type"), "url", at.alias("date"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Last-Modified"), day(at - at % 1000), F.lit("Date"), day(at),
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size, F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.md5("html").alias("payload_md5"), F.length("html").cast("long").alias("payload_chars"),
    )
    later = at + 1 + n % 50
    again = pages.select(
        (2 * n + 1).alias("record_id"), F.lit("revisit").alias("type"), "url", later.alias("date"),
        F.map_filter(F.create_map(
            F.lit("etag"), F.when(n % 7 == 0, F.lit('W/"other"')).when(n % 5 > 0, F.concat(F.lit("W/"), tag)),
            F.lit("last-modified"), day(at - at % 1000), F.lit("date"), day(later),
            F.lit("content-length"), F.lit("0"), F.lit("expires"), day(later + 60),
        ), lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("payload_md5"), F.lit(None).cast("long").alias("payload_chars"),
    )
    return first.union(again)


SQL = r"""
WITH p AS (
  SELECT page_id AS n, html, page_id * 37 % 100003 AS t,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS rest,
         '"' || substr(md5(html), 1, 12) || '"' AS tag
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         array_to_string(list_sort(list_filter(string_split(regexp_replace(
           regexp_extract(rest, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&'), lambda x: x <> '')), '&') AS asked
  FROM p
), u AS (
  SELECT *, place || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS canonical_url FROM c
), v AS (
  SELECT 2 * n + 1 AS record_id, canonical_url, t + 1 + n % 50 AS date, 't' || (t - t % 1000) AS modified,
         CASE WHEN n % 7 = 0 THEN '"other"' WHEN n % 5 > 0 THEN tag END AS tag,
         CASE WHEN n % 7 = 0 THEN 'W/"other"' WHEN n % 5 > 0 THEN 'W/' || tag END AS own_tag
  FROM u
), j AS (
  SELECT v.*, r.n AS rn, r.html, r.t AS rt, r.tag AS rtag
  FROM v LEFT JOIN u AS r ON r.canonical_url = v.canonical_url AND r.t < v.date
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.t DESC NULLS LAST, r.n DESC) = 1
), s AS (
  SELECT *, CASE WHEN rn IS NULL THEN 'orphan'
                 WHEN coalesce(tag = rtag, modified = 't' || (rt - rt % 1000)) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j
)
SELECT record_id, canonical_url, 2 * rn AS response_id, status,
  CASE WHEN status = 'resolved' THEN
    'cache-control=max-age=60|content-length=' || length(html) || '|content-type=text/html|date=t' || date || '|etag='
      || coalesce(own_tag, rtag) || '|expires=t' || (date + 60) || '|last-modified=' || modified
  ELSE 'content-length=0|date=t' || date || coalesce('|etag=' || own_tag, '') || '|expires=t' || (date + 60)
      || '|last-modified=' || modified END AS headers,
  CASE WHEN status = 'resolved' THEN md5(html) END AS payload_md5,
  CASE WHEN status = 'resolved' THEN length(html) END AS payload_chars
FROM s
"""


@query("op6_revisits", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_captures(table(spark, sf_dir, "pages")), ("payload_md5", "payload_chars"))
    entry = lambda e: F.concat(e.key, F.lit("="), e.value)
    return out.withColumn("headers", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), entry)), "|"))
