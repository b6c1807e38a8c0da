"""Groups of rows that small parts of a graph make, read as one stream a task; and the split of a graph's edges into parts of bounded size and what is larger."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandflow.lineage import near_components, written


def grouped_rows(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int | str, list[tuple]]]:
    """(group, rows) of frames that are sorted by their first column, the group, which their rows leave out."""
    key, held = None, []
    plain = lambda k: k.item() if isinstance(k, np.generic) else k
    for pdf in frames:
        group = pdf.iloc[:, 0].to_numpy()
        rows = list(zip(*(pdf.iloc[:, i].tolist() for i in range(1, pdf.shape[1]))))
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and group[lo] != key:
                yield plain(key), held
                held = []
            key = group[lo]
            held = held + rows[lo:hi] if held else rows[lo:hi]
    if held:
        yield plain(key), held


def in_groups(rows: DataFrame, found: Callable[[int | str, list[tuple]], Iterable[tuple]], schema: str, most: int = 4096) -> DataFrame:
    """What ``found`` gives for each group (first column) of ``rows``: many small groups are one task's stream, without a frame of their own."""
    names = [c.name for c in StructType.fromDDL(schema)]

    def run(frames):
        out = []
        for key, some in grouped_rows(frames):
            for row in found(key, some):
                out.append(row)
                if len(out) >= most:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, rows.columns[0]).sortWithinPartitions(rows.columns[0]).mapInPandas(run, schema)


def in_parts(edges: DataFrame, largest: int, tag: str, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(parts, large): the node (node, part, and w of ``weights`` (node_id, w), if given) of every edge (src, dst) of integers, and the parts (part) that have more than ``largest`` nodes, None where
    there are none."""
    parts = near_components(edges, "src", "dst", tag).select("node", F.col("component").alias("part"))
    if weights is not None:
        parts = parts.join(weights.select(F.col("node_id").alias("_id"), "w"), F.abs("node") == F.col("_id")).drop("_id")
    parts = written(parts, f"{tag}-parts")
    large = written(parts.groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > largest).select("part"), f"{tag}-large")
    return parts, large if large.limit(1).count() else None
