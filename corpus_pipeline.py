"""A corpus pipeline of five stages, each an operator of strandflow.llm over all that the stage before kept.

Defined results, for every stage: an empty table gives an empty table; columns beside doc_id, text and source ride along whatever their
names; null and empty texts stay where they are no copies, leaks or rejected (the mixture takes no words from them). Rows without a doc_id
and rows that share one are rows of their own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import forget, keyed, parallelism, without, written
from strandflow.llm.latent_decontamination import contaminated
from strandflow.llm.mixing import mixed
from strandflow.llm.quality_mil import accepted
from strandflow.llm.set_relation_join import jaccard_components
from strandflow.llm.sharding import interleaved_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingle similarity: that of the smallest id, rows without an id coming last; among equal ids any one."""
    rows, key = keyed(docs, "doc_id", "pipeline-keyed")
    groups = written(jaccard_components(rows, id_col=key).select(key, "component_id"), "pipeline-groups")
    if key == "doc_id":
        copies = groups.where("doc_id != component_id")
    else:
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key].alias(key)
        heads = groups.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(first)
        copies = groups.join(heads, key, "left_anti")
    kept = without(rows, copies.select(key), key, "pipeline-copies").select(*docs.columns)
    forget(groups)
    return kept


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item."""
    rows, key = keyed(docs, "doc_id", "pipeline-keyed")
    hits = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return without(rows, hits.select(key), key, "pipeline-leaks").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order in which the splitting tree dealt it: by the tree's shard, and within that as drawn."""
    out = mixed(docs, carry=tuple(docs.columns))
    rows = out.select("carried", F.explode("copies").alias("copy")).select("carried", "copy.*")
    return rows.repartitionByRange(parallelism(spark), "shard", "key").sortWithinPartitions("shard", "key").select("carried.*")


def _place(docs: DataFrame) -> Column:
    """Where a row stands in the files that ``docs`` is read from."""
    return F.struct(docs["_metadata.file_path"].alias("file"), docs["_metadata.row_index"].alias("row"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot. Rows read from files are taken in the order of these, which is the one that the mixture dealt, so copies of a document stand where their
    rounds do; others by a hash of their id, or of their number where ids don't tell them apart."""
    try:
        order = _place(docs)
        docs.select(order)
    except AnalysisException:  # not read from files
        docs, key = keyed(docs, "doc_id", "pipeline-keyed")
        order = F.xxhash64(F.lit("interleave"), F.col(key))
    return interleaved_shards(docs, order=order)


STAGES = [("quality", quality), ("ngram_jaccard_join", one_of_each_group), ("decontamination", decontaminated), ("mixing", mixture), ("sharding", shards)]

#: The classifier is fitted by gradient descent, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
