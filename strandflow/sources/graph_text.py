"""Assembly graphs in their tab-separated text form.

A header (nodes, sequences, k), then NODE blocks of a line and two sequence lines, ARC lines and NR blocks of read placements. Lines know
their block by a running maximum within sorted pieces, so no part of a file has to be parsed by one task alone after the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.lineage import global_rank, written
from strandflow.operators.graph import AssemblyGraph


def read_graph(spark: SparkSession, path: str) -> AssemblyGraph:
    """The graph in the file, with lengths as stored (the number of k-mers)."""
    lines = spark.read.text(path).withColumn("_p", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    lines = written(global_rank(lines, ["_p"], "graph-lines", "no").select("no", F.split("value", "\t").alias("f"), "value"), "graph-lines")
    head = lines.where("no = 0").select("f").first()["f"]
    k = int(head[2])
    kind = F.col("f")[0]
    node_lines = lines.where(kind == "NODE").select("no", F.col("f")[1].cast("int").alias("node_id"), F.col("f")[2].cast("int").alias("length"), F.col("f")[3].cast("long").alias("cov_sum"))
    at = lambda d, name: lines.select((F.col("no") - d).alias("no"), F.col("value").alias(name))
    nodes = node_lines.join(at(1, "ends_fwd"), "no").join(at(2, "ends_twin"), "no").drop("no")
    a = lines.where(kind == "ARC").select(F.col("f")[1].cast("int").alias("x"), F.col("f")[2].cast("int").alias("y"), F.col("f")[3].cast("long").alias("mult"))
    arcs = a.select(F.abs("x").alias("begin_id"), (F.col("x") > 0).alias("begin_fwd"), F.abs("y").alias("end_id"), (F.col("y") > 0).alias("end_fwd"), "mult")
    blocks = lines.where(kind == "NR").select(F.col("no").alias("b"), F.col("f")[1].cast("int").alias("node"), F.col("f")[2].cast("int").alias("n"))
    each = blocks.select("node", F.explode(F.when(F.col("n") > 0, F.sequence(F.col("b") + 1, F.col("b") + F.col("n"))).otherwise(F.array().cast("array<bigint>"))).alias("no"))
    placed = each.join(lines, "no").select(
        F.abs("node").alias("node_id"), F.col("f")[0].cast("int").alias("read_id"), F.col("f")[1].cast("int").alias("offset"), F.col("f")[2].cast("int").alias("start_coord"), (F.col("node") > 0).alias("fwd")
    )
    return AssemblyGraph(nodes, arcs, k, placed)


def save_graph(graph: AssemblyGraph, folder: str) -> None:
    """The graph as Parquet tables, to be reused."""
    graph.nodes.write.parquet(f"{folder}/nodes")
    graph.arcs.write.parquet(f"{folder}/arcs")
    graph.nodes.sparkSession.createDataFrame([(graph.k,)], "k int").write.parquet(f"{folder}/k")
    for name in ("noded_reads", "reads"):
        if getattr(graph, name) is not None:
            getattr(graph, name).write.parquet(f"{folder}/{name}")


def load_graph(spark: SparkSession, folder: str, probes: DataFrame | None = None) -> AssemblyGraph:
    """A saved graph; where probes (read_id, seq) are given they must be among its reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    optional = {n: spark.read.parquet(f"{folder}/{n}") if there(n) else None for n in ("noded_reads", "reads")}
    g = AssemblyGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/arcs"), spark.read.parquet(f"{folder}/k").first()[0], **optional)
    if probes is not None and probes.select("read_id", "seq").join(g.reads.select("read_id", "seq"), ["read_id", "seq"], "left_anti").limit(1).count():
        raise ValueError("the saved graph was made with other probes")
    return g
