"""Written tables that cut lineage, and connected components over them.

Tables go to the folder the cluster names in ``spark.checkpoint.dir``, which all executors share; a folder of our own
is used only in local runs whose session names none.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN = "strandflow.local.dir"
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # a session's folder, which doesn't change


def shared_dir(spark: SparkSession) -> str:
    if (known := _FOLDERS.get(spark)) is not None:
        return known
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get(_OWN, None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            named = "file://" + tempfile.mkdtemp(prefix="strandflow-")
            spark.conf.set(_OWN, named)
    _FOLDERS[spark] = named.rstrip("/")
    return _FOLDERS[spark]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandflow/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back with the same schema; ``options`` are the writer's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def measured(df: DataFrame, tag: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` as ``written`` gives it, and aggregates of its rows that the same job takes on the way."""
    seen = Observation()
    out = written(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), tag)
    return out, seen.get


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads; other frames have nothing to delete."""
    for df in tables:
        if (name := getattr(df, "_written_path", None)) is None:
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a written table) has at most so many rows; only then may it be broadcast."""
    return df.limit(rows + 1).count() <= rows


def dealt(df: DataFrame, rows: int, *keys: str | Column, most: int = 1 << 19) -> DataFrame:
    """``df`` of so many rows by ``keys``, over tasks whose number grows with the rows: what a task sorts or groups then doesn't."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // most)), *keys)


def _stars(most: int = 1 << 20):
    """Edges (u, v) of a task as stars: (node, smallest node of its part) in chunks of at most ``most`` edges."""

    def starred(u: np.ndarray, v: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            x, y = low[a], low[b]
            open_ = x != y
            if not open_.any():
                break
            x, y = x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
        inner = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[inner], kind), pa.array(nodes[low[inner]], kind)], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield starred(*(np.concatenate(x) for x in zip(*held)), batch.schema.field(0).type)
                held, n = [], 0
        if n:
            yield starred(*(np.concatenate(x) for x in zip(*held)), batch.schema.field(0).type)

    return run


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one center, which has none itself."""
    ends = stars.select(F.col("u").alias("x"), F.col("v").alias("center"), F.lit(False).alias("is_center")).unionByName(
        stars.select(F.col("v").alias("x"), F.lit(None).alias("center"), F.lit(True).alias("is_center"))
    )
    of = ends.groupBy("x").agg(F.min("center").alias("lo"), F.max("center").alias("hi"), F.max("is_center").alias("c"))
    return not of.where("lo != hi or (lo is not null and c)").limit(1).count()


def connected_components(edges: DataFrame, a: str, b: str, tag: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. Nodes are integers or texts.

    Each task first turns its edges into stars, in chunks of bounded size; then alternating large-star and small-star rounds meet in
    joins, each a written table. Nothing is collected. A hub's edges meet its minimum in a join that Spark can split, not in a group.
    """
    kind = "string" if edges.schema[a].dataType.simpleString() == "string" else "long"
    stars = lambda e: e.mapInArrow(_stars(), f"u {kind}, v {kind}")
    given = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v"))
    cur = written(stars(given.distinct()), f"{tag}-edges")
    for _ in range(rounds):
        if _settled(cur):
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        small = large.join(low, "u").select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.*").where("u != v").distinct()
        new = written(stars(small), f"{tag}-round")
        forget(cur)
        cur = new
    else:
        raise RuntimeError("components did not settle")
    cur = cur.distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_components(edges: DataFrame, a: str, b: str, tag: str) -> DataFrame:
    """As ``connected_components``, for integer edges whose neighbours mostly lie in one task: each task's edges become stars as they come, and only the centers of stars that share a node go
    through rounds. A row for each node is shuffled once."""
    given = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    stars = written(given.mapInArrow(_stars(), "u long, v long"), f"{tag}-stars")
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("center")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("center")))
    met, seen = measured(ends.groupBy("node").agg(F.min("center").alias("lo"), F.max("center").alias("hi")), f"{tag}-met", shared=F.count_if(F.col("lo") != F.col("hi")))
    if not seen["shared"]:
        return met.select("node", F.col("lo").alias("component"))
    links = ends.join(met.where("lo != hi").select("node", "lo"), "node").where("center != lo").select("center", "lo")
    over = written(connected_components(links, "center", "lo", tag), f"{tag}-over").withColumnsRenamed({"node": "lo", "component": "_over"})
    return met.join(over, "lo", "left").select("node", F.coalesce("_over", "lo").alias("component"))


def global_rank(df: DataFrame, keys: list, tag: str, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row under the total order ``keys``: one range-partitioned sort, and a count for each partition.
    ``forget`` of the result deletes the sorted table behind it."""
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = written(placed, tag)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    out = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_before")
    out._written_path = placed._written_path
    return out
