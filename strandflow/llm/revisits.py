"""Not-modified revisit records of web archives, resolved to full responses.

A revisit takes the latest earlier full response of its canonical URL (order: time, then record id). Validators
are compared weakly: entity tags where the revisit has one, else the modification time. A verified revisit
gets the response's headers, updated by those of its own that a not-modified answer may change.

The as-of join has two levels, so no URL needs one task: rows meet by (URL, time bucket) in a window, and a
bucket without a response before the row takes the last one of earlier buckets, found over one row a bucket. A bucket is a day, or where
a URL has more than ``hot`` records on a day a part of it, of a second at least.
Payloads aren't moved; the result names the response whose payload holds.

Defined results: records without URL or time are unresolved; ties in time are ordered by record id and a null id
comes first; a revisit without validators is ``unverified``; repeated revisits are resolved one by one; an empty
table gives no rows; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, written
from .urls import CANONICAL_SQL, canonical

# Fixed header names that a 304 answer may set or update
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400, hot: int = 200_000) -> DataFrame:
    """records: (record_id, url, ts long seconds, kind 'response' or 'revisit', etag, modified long, headers map).

    A row for each revisit: record_id, url_key, ts, target_id, target_ts, status (resolved, mismatch, unverified or
    missing) and headers (merged when resolved, else its own)."""
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", "etag", "modified", "headers",
        (F.col("ts") - F.pmod("ts", F.lit(bucket_seconds))).alias("bucket"),
    )
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "modified", "headers"))
    rows = rows.withColumn("full", full)
    keyed = rows.where("url_key is not null and ts is not null")
    busy = written(keyed.groupBy("url_key", "bucket").count().where(F.col("count") > hot), "w1-busy")
    if busy.limit(1).count():  # all records of a URL and day share one width, so buckets follow each other by their begin
        width = F.greatest(F.lit(1), F.floor(F.lit(bucket_seconds) / F.ceil(F.col("count") / hot)))
        keyed = keyed.join(F.broadcast(busy) if bounded(busy, 1_000_000) else busy, ["url_key", "bucket"], "left")
        keyed = keyed.withColumn("bucket", F.when(F.col("count").isNull(), F.col("bucket")).otherwise(F.col("ts") - F.pmod(F.col("ts") - F.col("bucket"), width))).drop("count")
    earlier = Window.partitionBy("url_key", "bucket").orderBy("ts", F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("found", F.last("full", ignorenulls=True).over(earlier)).where("kind = 'revisit'")
    order = F.struct(F.col("ts"), F.col("record_id"))
    by_bucket = keyed.where("full is not null").groupBy("url_key", "bucket").agg(F.max_by("full", order).alias("own"))
    # a bucket with revisits but without responses still needs the carry: both kinds of buckets take part
    marks = keyed.where("kind = 'revisit'").select("url_key", "bucket").distinct().join(by_bucket, ["url_key", "bucket"], "full_outer")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "bucket", F.last("own", ignorenulls=True).over(before).alias("carry")).where("carry is not null")
    joined = near.join(carried, ["url_key", "bucket"], "left").withColumn("hit", F.coalesce("found", "carry"))
    lost = rows.where("kind = 'revisit' and (url_key is null or ts is null)")
    joined = joined.select("record_id", "url_key", "ts", "etag", "modified", "headers", "hit").unionByName(
        lost.select("record_id", "url_key", "ts", "etag", "modified", "headers", F.lit(None).cast(keyed.schema["full"].dataType).alias("hit"))
    )
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    status = (
        F.when(F.col("hit").isNull(), "missing")
        .when(F.col("etag").isNotNull(), F.when(weak(F.col("etag")) == weak(F.col("hit.etag")), "resolved").otherwise("mismatch"))
        .when(F.col("modified").isNotNull(), F.when(F.col("modified") == F.col("hit.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    base = F.coalesce(F.col("hit.headers"), F.create_map().cast("map<string,string>"))
    allowed = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_zip_with(base, allowed, lambda k, a, b: F.coalesce(b, a))
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "ts", F.col("hit.record_id").alias("target_id"), F.col("hit.ts").alias("target_ts"), "status",
        F.when(F.col("status") == "resolved", merged).otherwise(own).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """The pages table as archive records: each page is captured one to four times, 400,000 s apart, first in full and later mostly
    as not modified, under spellings of its URL; its version changes every 15 days."""
    p = pages.select("page_id", "url", F.coalesce(F.length("html"), F.lit(0)).alias("size"))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 4)))
    p = p.withColumn("ts", F.lit(1_700_000_000) + F.col("page_id") * 7919 % 2_592_000 + F.col("j") * 400_000).withColumn("version", F.expr("ts div 1296000"))
    p = p.withColumn("again", (F.col("j") % 2 == 1) | ((F.col("j") == 2) & (F.col("page_id") % 5 != 0)))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.concat(canonical(F.col("url")), F.lit("/"), F.col("version").cast("string"))), 1, 12), F.lit('"'))
    etag = F.when(F.col("page_id") % 32 == 11, F.lit(None)).when(F.col("page_id") % 16 == 3, F.concat(F.lit("W/"), tag)).otherwise(tag)
    headers = F.map_from_arrays(
        F.array(*map(F.lit, ("cache-control", "content-length", "content-type", "date"))),
        F.array(
            F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string")),
            F.when(F.col("again"), F.lit("0")).otherwise(F.col("size").cast("string")),
            F.when(F.col("again"), F.lit("text/plain")).otherwise(F.lit("text/html")),
            F.col("ts").cast("string"),
        ),
    )
    spelled = F.when(F.col("j") == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).otherwise(F.col("url"))
    return p.select(
        (F.col("page_id") * 4 + F.col("j")).alias("record_id"), spelled.alias("url"), "ts", F.when(F.col("again"), "revisit").otherwise("response").alias("kind"),
        etag.alias("etag"), (F.col("version") * 1_296_000).alias("modified"), headers.alias("headers"),
    )


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("headers", text)


OP1_SQL = f"""
WITH p0 AS (SELECT page_id, {CANONICAL_SQL} AS url_key, coalesce(length(html), 0) AS size, unnest(range(0, page_id % 4 + 1)) AS j FROM pages),
p AS (SELECT *, 1700000000 + page_id * 7919 % 2592000 + j * 400000 AS ts, page_id * 4 + j AS record_id, j % 2 = 1 OR (j = 2 AND page_id % 5 <> 0) AS again FROM p0),
v AS (SELECT *, ts // 1296000 AS version, CASE WHEN page_id % 32 = 11 THEN NULL ELSE '"' || substr(md5(url_key || '/' || CAST(ts // 1296000 AS VARCHAR)), 1, 12) || '"' END AS etag FROM p),
j AS (SELECT q.record_id, q.page_id, q.url_key, q.ts, q.etag, q.version, r.record_id AS target_id, r.ts AS target_ts, r.etag AS t_etag, r.version AS t_version, r.size AS t_size,
  row_number() OVER (PARTITION BY q.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC NULLS LAST) AS k
  FROM (SELECT * FROM v WHERE again) q LEFT JOIN (SELECT * FROM v WHERE NOT again) r ON q.url_key = r.url_key AND (r.ts < q.ts OR (r.ts = q.ts AND r.record_id < q.record_id))),
s AS (SELECT *, CASE WHEN target_id IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN etag = t_etag THEN 'resolved' ELSE 'mismatch' END
  WHEN version = t_version THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE k = 1)
SELECT record_id, url_key, CAST(ts AS BIGINT) AS ts, target_id, CAST(target_ts AS BIGINT) AS target_ts, status,
  'cache-control=max-age=' || CAST(page_id % 100 AS VARCHAR) || ';content-length=' || CASE WHEN status = 'resolved' THEN CAST(t_size AS VARCHAR) ELSE '0' END
  || ';content-type=' || CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'text/plain' END || ';date=' || CAST(ts AS VARCHAR) AS headers
FROM s
"""
