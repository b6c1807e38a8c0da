"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.lineage import bounded, connected_components, forget, global_rank, new_path, shared_dir, written

__all__ = ["bounded", "clustered", "connected_components", "forget", "global_rank", "keyed", "nameless", "new_path", "numbered", "parallelism", "shared_dir", "text_batches", "without", "written"]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows for this session: a batch of whole texts must fit beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-dealt by ``keys`` into the session's number of shuffle partitions."""
    return df.repartition(parallelism(df.sparkSession), *keys)


def numbered(docs: DataFrame, col: str, tag: str) -> tuple[DataFrame, int | None]:
    """``docs`` with ids beyond the largest, which is returned too, for rows without one; ``docs`` as it is and None where every row has its id."""
    if not docs.where(F.col(col).isNull()).limit(1).count():
        return docs, None
    top = docs.agg(F.coalesce(F.max(col).cast("long"), F.lit(0).cast("long"))).first()[0]
    own = F.lit(top + 1) + F.monotonically_increasing_id()
    return written(docs.withColumn(col, F.coalesce(F.col(col).cast("long"), own)), tag), top  # written: read again, rows keep their numbers


def nameless(docs: DataFrame, top: int | None, *cols: str) -> DataFrame:
    """Takes the ids that ``numbered`` gave back out of ``cols``."""
    for c in cols if top is not None else ():
        docs = docs.withColumn(c, F.when(F.col(c) <= top, F.col(c)))
    return docs


def keyed(docs: DataFrame, col: str, tag: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: ``col`` where every row has its own value there, else a further column."""
    if not docs.groupBy(col).count().where(F.col(col).isNull() | (F.col("count") > 1)).limit(1).count():
        return docs, col
    name = "row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), tag), name  # written: read again, rows keep their numbers


def without(docs: DataFrame, ids: DataFrame, col: str, tag: str, rows: int = 1_000_000) -> DataFrame:
    """``docs`` whose ``col`` isn't among ``ids``; the ids are broadcast only where they are few (8 bytes each)."""
    gone = written(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), tag)
    return docs.join(F.broadcast(gone) if bounded(gone, rows) else gone, col, "left_anti").select(*docs.columns)
