"""The queries of this subpackage, by name: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .impact_topk import OP11_SQL, op11_impact_topk
from .latent_decontamination import op10_latent_decontamination
from .middle import OP13_SQL, op13_fill_in_middle
from .mixing import mixed
from .quality_mil import op7_attention_quality
from .revisits import OP1_SQL, op1_revisit_resolution
from .secrets import op4_ownership_secrets
from .set_relation_join import OP9_SQL, jaccard_components
from .sharding import interleaved_shards
from .temporal_lists import OP3_SQL, op3_temporal_lists
from .token_sequences import op2_arrow_sequences
from .turn_repair import op12_turn_repair
from .vector_passes import OP5_SQL, op5_sorted_projection_passes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shards``: the output shards, ascending, that the splitting tree gives a document to, one for each time it is taken."""
    shards = F.array_join(F.array_sort(F.transform("copies", lambda c: c["shard"])).cast("array<string>"), ",")
    return mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(_documents(spark, sf_dir))


def op9_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_revisit_resolution,
        op2_arrow_sequences,
        op3_temporal_lists,
        op4_ownership_secrets,
        op5_sorted_projection_passes,
        op6_hypergeometric_mix,
        op7_attention_quality,
        op8_interleaved_shards,
        op9_set_relation_join,
        op10_latent_decontamination,
        op11_impact_topk,
        op12_turn_repair,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {"op1_revisit_resolution": OP1_SQL, "op3_temporal_lists": OP3_SQL, "op5_sorted_projection_passes": OP5_SQL, "op9_set_relation_join": OP9_SQL, "op11_impact_topk": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
