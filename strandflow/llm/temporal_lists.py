"""URL filtering against dated lists.

List events (domain, category, day added or removed) become validity intervals, and per domain one row holds
its history: the categories that are active from each moment on. A capture's host and parent domains look
up that history and take the state at or before the fetch time, so each capture is judged by the list as it was.

Skew: one domain's history is one row, so a host with a third of all captures is a join that Spark may split on
the captures' side; parents that no list names (``com``) are dropped before that, by the list's names where they are at most
``broadcast_rows``. List events are bounded by the list's own upkeep, not by captures.

Defined results: captures without host or time match nothing and are allowed; an event at the fetch second counts; of
events of one domain and category at one second a removal comes last; repeated events are one; empty lists allow
everything; an empty captures table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, written
from .urls import HOST_SQL, host


def validity_intervals(events: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to) from (domain, category, ts, added); valid_to is exclusive, null while open."""
    e = events.where("domain is not null and category is not null and ts is not null").select(
        F.lower("domain").alias("domain"), "category", "ts", F.coalesce("added", F.lit(False)).alias("added")
    )
    e = e.groupBy("domain", "category", "ts").agg(F.min("added").alias("added"))
    own = Window.partitionBy("domain", "category").orderBy("ts")
    e = e.withColumn("was", F.lag("added").over(own)).where("was is null or was != added")  # changes of state only
    e = e.withColumn("valid_to", F.lead("ts").over(own)).where("added")
    return e.select("domain", "category", F.col("ts").alias("valid_from"), "valid_to")


def histories(intervals: DataFrame) -> DataFrame:
    """(domain, steps): the moments at which a domain's active categories change, ascending, each with the categories active from then on."""
    spans = intervals.groupBy("domain").agg(F.collect_list(F.struct("valid_from", "valid_to", "category")).alias("spans"))
    moments = F.expr("array_sort(array_distinct(filter(concat(transform(spans, s -> s.valid_from), transform(spans, s -> s.valid_to)), t -> t is not null)))")
    return spans.withColumn("moments", moments).select(
        "domain",
        F.expr("""transform(moments, m -> named_struct('ts', m, 'active',
            array_sort(array_distinct(transform(filter(spans, s -> s.valid_from <= m and (s.valid_to is null or s.valid_to > m)), s -> s.category)))))""").alias("steps"),
    )


def judged(captures: DataFrame, events: DataFrame, id_col: str = "capture_id", url_col: str = "url", ts_col: str = "ts", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, ts, matched, categories, allowed) for each capture; matched and categories are comma-joined."""
    history = written(histories(validity_intervals(events)), "u3-histories")
    names = history.select("domain")
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(ts_col).cast("long").alias("ts"), host(F.col(url_col)).alias("host")
    )
    parents = rows.where("host != '' and ts is not null").select(
        "row", "ts",
        F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")).alias("domain"),
    )
    if bounded(names, broadcast_rows):
        parents = parents.join(F.broadcast(names), "domain", "left_semi")
    state = F.expr("element_at(filter(steps, s -> s.ts <= ts), -1)")
    hits = parents.join(history, "domain").select("row", "domain", F.when(F.expr("exists(steps, s -> s.ts <= ts)"), state).alias("state"))
    hits = hits.where("state is not null and size(state.active) > 0").groupBy("row").agg(
        F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("matched"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("state.active")))), ",").alias("categories"),
    )
    return rows.join(hits, "row", "left").select(
        F.col("id").alias(id_col), "ts", F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("categories", F.lit("")).alias("categories"),
        F.col("matched").isNull().alias("allowed"),
    )


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' hosts: every fifth page adds or removes its host or, rarely, its parent domain."""
    p = pages.where(F.col("page_id") % 5 == 0).withColumn("host", host(F.col("url")))
    return p.select(
        F.when(F.col("page_id") % 250 == 0, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host")).alias("domain"),
        F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("phishing")), (F.col("page_id") % 3 + 1).cast("int")).alias("category"),
        (F.lit(1_700_000_000) + F.col("page_id") * 104_729 % 2_592_000).alias("ts"),
        (F.col("page_id") % 7 < 4).alias("added"),
    )


def op3_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", (F.lit(1_700_000_000) + F.col("page_id") * 7919 % 2_592_000).alias("ts"))
    return judged(captures, list_events(pages), "page_id")


OP3_SQL = f"""
WITH p AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
e0 AS (SELECT CASE WHEN page_id % 250 = 0 THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END AS domain,
  ['adult', 'malware', 'phishing'][page_id % 3 + 1] AS category, 1700000000 + page_id * 104729 % 2592000 AS ts, page_id % 7 < 4 AS added FROM p WHERE page_id % 5 = 0),
e AS (SELECT domain, category, ts, bool_and(added) AS added FROM e0 GROUP BY ALL),
i AS (SELECT domain, category, ts AS valid_from, lead(ts) OVER (PARTITION BY domain, category ORDER BY ts) AS valid_to, added FROM e),
c AS (SELECT page_id, 1700000000 + page_id * 7919 % 2592000 AS ts, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p),
d AS (SELECT page_id, ts, array_to_string(string_split(host, '.')[k:], '.') AS domain FROM c),
h AS (SELECT d.page_id, d.domain, i.category FROM d JOIN i ON d.domain = i.domain AND i.added AND i.valid_from <= d.ts AND (i.valid_to IS NULL OR i.valid_to > d.ts)),
m AS (SELECT page_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS matched, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM h GROUP BY page_id)
SELECT p.page_id, CAST(1700000000 + p.page_id * 7919 % 2592000 AS BIGINT) AS ts, coalesce(m.matched, '') AS matched, coalesce(m.categories, '') AS categories, m.matched IS NULL AS allowed
FROM p LEFT JOIN m USING (page_id)
"""
