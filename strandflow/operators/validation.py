"""Comparing sequence sets and simulating gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(same, different): sequences by name; a name that is double or on one side only raises."""

    def once(df, side):
        n = F.count("*").over(Window.partitionBy(name))
        return df.select(name, F.when(n == 1, F.col(seq)).otherwise(F.raise_error(F.concat(F.lit("a name is double: "), F.col(name))).cast("string")).alias(side))

    both = once(a, "_a").join(once(b, "_b"), name, "full_outer")
    lone = F.raise_error(F.concat(F.lit("a name is on one side only: "), F.col(name))).cast("boolean")
    same = F.when(F.col("_a").isNull() | F.col("_b").isNull(), lone).otherwise(F.col("_a") == F.col("_b"))
    return both.select(same.alias("s")).agg(F.count_if("s").alias("same"), F.count_if(~F.col("s")).alias("different"))


def simulate_gaps(seqs: DataFrame, n: int = 100, smallest: int = 100, largest: int = 1000, buffer: int = 2000, seed: int = 1, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, start, length, gapped): ``n`` seeded choices of sequences long enough, each with one run of N away from its ends."""
    h = lambda what, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(name)), m)
    rows = seqs.where(F.length(seq) >= 2 * buffer + largest).orderBy(F.xxhash64(F.lit(seed), F.col(name)), name).limit(n)
    rows = rows.withColumn("length", (h("length", F.lit(largest - smallest + 1)) + smallest).cast("int"))
    rows = rows.withColumn("start", (h("start", F.length(seq) - 2 * buffer - F.col("length") + 1) + buffer).cast("int"))
    return rows.select(name, "start", "length", F.overlay(F.col(seq), F.repeat(F.lit("N"), F.col("length")), F.col("start") + 1, F.col("length")).alias("gapped"))
