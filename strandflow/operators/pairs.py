"""Neighbours across read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_distance(insert: int):
    """Bases between two nodes for one read pair, null where the pair can't be so far apart."""
    d = F.lit(insert) - (F.col("len1") - F.col("off1") + F.col("start1")) - (F.col("len2") - F.col("off2") + F.col("start2"))
    return F.when((d <= 2 * insert) & (d >= -insert), d)


def paired_neighbours(
    noded_reads: DataFrame, pairs: DataFrame, nodes: DataFrame, insert: int, min_adjoining_reads: int = 2, max_adjoining_node_coverage: float | None = 300.0
) -> DataFrame:
    """(src, dst, gap, n): oriented nodes joined by read pairs that face the way of travel. The mates vote on how the other node is entered; the
    distance is the mean over the winning votes, at least 0."""
    size = nodes.select("node_id", "length", (F.col("cov_sum") / F.col("length")).alias("cov"))
    here = noded_reads.join(size, "node_id").select(
        "read_id", F.when(F.col("fwd"), F.col("node_id")).otherwise(-F.col("node_id")).alias("src"), F.col("length").alias("len1"),
        F.col("offset").alias("off1"), F.col("start_coord").alias("start1"),
    )
    allowed = size if max_adjoining_node_coverage is None else size.where(F.col("cov") <= max_adjoining_node_coverage)
    there = noded_reads.join(allowed, "node_id").select(
        F.col("read_id").alias("pair_id"), F.when(F.col("fwd"), -F.col("node_id")).otherwise(F.col("node_id")).alias("dst"), F.col("length").alias("len2"),
        F.col("offset").alias("off2"), F.col("start_coord").alias("start2"),
    )
    rows = here.join(pairs, "read_id").join(there, "pair_id").where(F.abs("src") != F.abs("dst")).withColumn("gap", pair_distance(insert)).where("gap is not null")
    votes = rows.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg("gap").alias("gap"))
    best = Window.partitionBy("src", F.abs("dst")).orderBy(F.col("n").desc(), F.col("dst").desc())
    won = votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").where(F.col("n") >= min_adjoining_reads)
    return won.select("src", "dst", F.greatest("gap", F.lit(0.0)).alias("gap"), "n")


def all_neighbours(edges: DataFrame, paired: DataFrame) -> DataFrame:
    """(src, dst, gap): direct neighbours at 0, and paired ones whose node isn't a direct neighbour."""
    direct = edges.select("src", "dst", F.lit(0.0).alias("gap"))
    known = direct.select("src", F.abs("dst").alias("_a")).distinct()
    rest = paired.withColumn("_a", F.abs("dst")).join(known, ["src", "_a"], "left_anti").select("src", "dst", "gap")
    return direct.unionByName(rest)


def paired_links(paired: DataFrame) -> DataFrame:
    """(node_id, links): the nodes that pairs lead to from either side of each node."""
    return paired.groupBy(F.abs("src").alias("node_id")).agg(F.sort_array(F.collect_set(F.abs("dst"))).alias("links"))
