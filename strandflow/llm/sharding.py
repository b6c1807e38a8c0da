"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row's fractional rank is (rank + 1/2) / rows of its source.
Sorted by fractional rank, every stretch holds the sources in the mixture's proportions, and the sorted rows
are cut into shards whose row counts differ by one at most. Both ranks come from range-partitioned sorts of
narrow rows (id, source, size, checksum), so a source with a third of all rows is many tasks' work.

``order`` takes the rows of a source in a given order instead, one that was drawn before: sources stay interleaved, and what stands together in it comes to the same or
neighbouring shards.

Defined results: null text counts no bytes and has checksum 0; null source is a source; equal rows get
different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, global_rank, written


def interleaved_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "interleave", order: Column | None = None
) -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, grown_shard) for each row; the law is ``rows``. ``order`` is a column by which a source's rows are ranked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        (F.xxhash64(F.lit(seed), F.col(id_col)) if order is None else order).alias("mix"),
    )
    ranked = global_rank(rows, ["source", "mix", "id", "text_crc32"], "s8-source", "r")
    first = written(ranked, "s8-ranked")
    forget(ranked)
    total = first.count()
    sources = first.groupBy("source").agg(F.min("r").alias("r0"), F.count("*").alias("n"))
    placed = first.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select(
        "id", "source", "size", "text_crc32", "mix", ((F.col("r") - F.col("r0") + F.lit(0.5)) / F.col("n")).alias("fraction")
    )
    last = global_rank(placed, ["fraction", "mix", "id", "text_crc32"], "s8-mixed", "r")
    out = last.withColumn("shard", F.expr(f"(r * {shards}L) div {max(total, 1)}L").cast("int")).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("r") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return out


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents under ``path``/shard=<n>/, in slot order in each file."""
    joined = docs.join(assigned.select(id_col, "shard", "slot"), id_col)
    n = max(1, assigned.agg(F.max("shard")).first()[0] or 0) + 1
    joined.repartition(n, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
