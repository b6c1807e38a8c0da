"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by ``bits`` concatenated random-hyperplane hashes and
compares every vector with the ``window`` before it; verified pairs (cosine in double precision) are
united across passes. Planes go through the mean direction of the label, so bits tell vectors of one topic apart; verification is on the vectors as
given. Equal vectors are one class from the start, so copies never fill a window. Within a
block of a pass only a spanning forest of the verified pairs is emitted: at most one row a vector.

``n_links`` is then completed exactly inside each component: its vectors are dealt to chunks, and chunk pairs
are compared by matrix products that emit one count a vector, never the pairs. A component beyond a chunk is
many tasks' work.

Recall: a pair at the threshold, whose vectors lie d off the mean, shares a bit with probability p = 1 - acos(1 - (1 - threshold) / d**2) / pi, and stands in a window if it shares
the bits that a vector shares with the one a window away, and one more. Both are measured in every block of the first passes, for every vector that isn't itself linked to the one
a window away (those have a window of links to be found by), and each label gets the passes of ``LADDER`` after which the measured share of missed pairs is ``miss`` at
most, or the ladder's last. Labels that need no more passes aren't read again. Measured recall is in the README.

Vectors travel as given (32 bits a number where they are floats) and are widened to double precision where they are compared. Passes run
``together`` at a time, and each group's sorted table is deleted before the next.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing; vectors of different lengths are not compared; repeated rows, and rows that share an id, are vectors of their own; rows
without an id link like others, never name a component, and are kept where no row of their component has an id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, connected_components, forget, global_rank, written

LADDER = (8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)


def _unit(parts, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), kind).astype(np.float64).reshape(len(parts), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _read(kind: str):
    """Vectors in binary, with their length and a 128-bit digest; these are null where a vector can't link."""

    def run(batches):
        for batch in batches:
            d0, d1, raw, dims = [], [], [], []
            for label, v in zip(batch.column(1), batch.column(2)):
                x = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
                if x is None or not np.isfinite(x).all() or not x.any():
                    d0.append(None)
                    d1.append(None)
                    raw.append(None)
                    dims.append(None)
                    continue
                d = xxhash.xxh3_128_digest(x.tobytes())
                d0.append(int.from_bytes(d[:8], "little", signed=True))
                d1.append(int.from_bytes(d[8:], "little", signed=True))
                raw.append(x.tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(raw, pa.binary())],
                ["id", "label", "dim", "d0", "d1", "v"],
            )

    return run


def _sums(kind: str, most: int = 4096):
    """Sums of a task's unit vectors by label and length, some labels at a time."""

    def out(held):
        labels, dims = zip(*held)
        ns, sums = zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(ns, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["label", "dim", "n", "sum"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], axis=1)
            for label, dim in np.unique(keys, axis=0).tolist():
                x = _unit(batch.column(2).filter(pa.array((keys == (label, dim)).all(axis=1))).to_pylist(), kind)
                n, total = held.get((label, dim), (0, 0.0))
                held[label, dim] = n + len(x), total + x.sum(axis=0)
            if len(held) > most:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return run


def _mean(table):
    total = np.frombuffer(b"".join(table.column("sum").to_pylist()), np.float64).reshape(table.num_rows, -1).sum(axis=0)
    n = sum(table.column("n").to_pylist())
    return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "n": pa.array([n], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())})


def means(classes: DataFrame, kind: str) -> DataFrame:
    """(label, dim, n, sum): how many unit vectors there are and what they add up to, first within tasks, then within parts of a label."""
    shape = "label long, dim int, n long, sum binary"
    parts = classes.select("label", "dim", "v").mapInArrow(_sums(kind), shape).withColumn("_p", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    some = parts.groupBy("label", "dim", "_p").applyInArrow(lambda t: _mean(t), shape)
    return written(some.groupBy("label", "dim").applyInArrow(lambda t: _mean(t), shape), "v5-means")


def _keyed(passes: range, bits: int, seed: int, kind: str):
    """Each vector's key in each pass, and how far it lies off its label's mean (squared)."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.hstack([np.random.default_rng([seed, int(dim), p]).standard_normal((int(dim), bits)) for p in passes])
                mean = np.frombuffer(b"".join(part.column(5).to_pylist()), np.float64).reshape(part.num_rows, -1) / part.column(4).to_numpy()[:, None]
                off = _unit(part.column(3).to_pylist(), kind) - mean
                signs = (off @ planes[dim] > 0).reshape(part.num_rows, len(passes), bits)
                keys = np.packbits(signs, axis=2)  # bytes compare as the bits do
                far = pa.array((off * off).sum(axis=1), pa.float64())
                for n, p in enumerate(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, p, np.int32)), *part.columns[1:3], pa.array([k.tobytes() for k in keys[:, n]], pa.binary()), part.column(0), far, part.column(3)],
                        ["pass", "label", "dim", "key", "cls", "far", "v"],
                    )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same of n things as (a, b): each to the first of its part."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low[low] != low).any():
            low = low[low]
    inner = np.flatnonzero(low != np.arange(n))
    return inner, low[inner]


def _shared(keys: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many leading bits rows of packed keys share."""
    differ = np.unpackbits(keys ^ other, axis=1)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])


def _window_pairs(window: int, block: int, threshold: float, kind: str, tile: int = 512):
    """Verified pairs of a block as a forest, and what its vectors tell of pairs missed: by label the number of vectors and their misses after each of ``LADDER`` passes."""

    def run(key, table):
        first = key[0].as_py() * block
        table = table.sort_by("rank")
        rank, cls, far = (table.column(c).to_numpy() for c in ("rank", "cls", "far"))
        same = [table.column(c).to_numpy() for c in ("pass", "label", "dim")]
        a, b, told = [], [], {}
        dims = same[2]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = _unit(table.column("v").take(pa.array(at)).to_pylist(), kind)
            keys = np.frombuffer(b"".join(table.column("key").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            r, g, l, c = rank[at], same[0][at], same[1][at], cls[at]
            left, right = [], []
            for lo in range(0, len(at), tile):
                hi = min(lo + tile, len(at))
                i, j = np.nonzero(x[lo:hi] @ x[lo : min(hi + window, len(at))].T >= threshold)
                i, j = i + lo, j + lo
                ok = (j > i) & (r[j] - r[i] <= window) & (r[j] >= first) & (g[i] == g[j]) & (l[i] == l[j])
                left.append(i[ok])
                right.append(j[ok])
            u, v = _forest(np.concatenate(left), np.concatenate(right), len(at))
            a.append(c[u])
            b.append(c[v])
            # the vector a window away, on the side on which there is one
            mine = np.flatnonzero(r >= first)
            edge = np.full(len(mine), -1)
            for step in (window, -window):
                j = np.minimum(np.searchsorted(r, r[mine] + step), len(r) - 1)
                there = (r[j] == r[mine] + step) & (g[j] == g[mine]) & (l[j] == l[mine])
                edge[there] = j[there]
            bits = np.where(edge >= 0, 1 + _shared(keys[mine], keys[np.maximum(edge, 0)]), 0)
            free = (edge < 0) | (np.einsum("ij,ij->i", x[mine], x[np.maximum(edge, 0)]) < threshold)
            turn = np.arccos(np.clip(1 - (1 - threshold) / np.maximum(far[at][mine], 1e-12), -1, 1)) / np.pi
            met = (1 - turn) ** bits
            for label in np.unique(l[mine]).tolist():
                seen = free & (l[mine] == label)
                told[label, int(dim)] = (int(seen.sum()), [float(((1 - met[seen]) ** n).sum()) for n in LADDER])
        a, b = np.concatenate(a), np.concatenate(b)
        n, m = len(a), len(told)
        columns = {
            "a": [pa.array(a, pa.int64()), pa.nulls(m, pa.int64())], "b": [pa.array(b, pa.int64()), pa.nulls(m, pa.int64())],
            "label": [pa.nulls(n, pa.int64()), pa.array([x for x, _ in told], pa.int64())], "dim": [pa.nulls(n, pa.int32()), pa.array([x for _, x in told], pa.int32())],
            "n": [pa.nulls(n, pa.int64()), pa.array([x for x, _ in told.values()], pa.int64())],
            "missed": [pa.nulls(n, pa.list_(pa.float64())), pa.array([x for _, x in told.values()], pa.list_(pa.float64()))],
        }
        return pa.table({name: pa.concat_arrays(parts) for name, parts in columns.items()})

    return run


def _passes(found: DataFrame, miss: float, least: int) -> DataFrame:
    """(label, dim, passes): the passes each label needs, by what the first ones told."""
    sums = [F.sum(F.col("missed")[i]).alias(f"m{i}") for i in range(len(LADDER))]
    of = found.where("label is not null").groupBy("label", "dim").agg(F.sum("n").alias("n"), *sums)
    enough = F.lit(LADDER[-1])
    for i in reversed(range(len(LADDER))):
        enough = F.when(F.col(f"m{i}") <= miss * F.col("n"), F.lit(LADDER[i])).otherwise(enough)
    return of.select("label", "dim", F.greatest(enough, F.lit(least)).alias("passes"))


def _counts(threshold: float, kind: str):
    """Links of each class within its component, over one bucket of small components or one pair of chunks."""

    def run(table):
        cls, comp, side, copies = (table.column(c).to_numpy() for c in ("cls", "comp", "side", "copies"))
        order = np.argsort(comp, kind="stable")
        ids, links = [], []
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            x = _unit(table.column("v").take(pa.array(at)).to_pylist(), kind)
            lo, hi = np.flatnonzero(side[at] <= 0), np.flatnonzero(side[at] >= 0)  # side: -1 first chunk, 1 second, 0 both
            near = x[lo] @ x[hi].T >= threshold
            near &= cls[at][lo][:, None] != cls[at][hi][None, :]
            ids.append(cls[at][lo])
            links.append(near @ copies[at][hi])
            if (side[at] != 0).any():
                ids.append(cls[at][hi])
                links.append(copies[at][lo] @ near)
        return pa.table({"cls": pa.array(np.concatenate(ids), pa.int64()), "links": pa.array(np.concatenate(links).astype(np.int64))})

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    passes: int = 8, bits: int = 64, window: int = 256, block: int = 4096, chunk: int = 1024, seed: int = 7,
    miss: float = 1e-3, together: int = 8, broadcast_bytes: int = 1 << 23,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row. ``passes`` is their least number; means of labels are broadcast up to ``broadcast_bytes``."""
    items = vectors.schema[vec_col].dataType.elementType.typeName()
    kind, given = ("<f4", F.col(vec_col)) if items == "float" else ("<f8", F.col(vec_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), given.alias("v"))
    rows = written(rows.mapInArrow(_read(kind), "id long, label long, dim int, d0 long, d1 long, v binary"), "v5-rows")
    good = rows.where("dim is not null")
    same = ["label", "dim", "d0", "d1"]
    classes = good.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "v5-classes")
    centers = means(classes, kind)
    wide = classes.agg(F.max("dim")).first()[0] or 1
    near = lambda df: F.broadcast(df) if bounded(df, broadcast_bytes // (8 * wide)) else df
    found, start, last, wanted = [], 0, together, None
    while start < last:
        some = classes.select("cls", "label", "dim", "v")
        if wanted is not None:
            some = some.join(near(written(wanted.where(F.col("passes") > start).select("label", "dim"), "v5-wanted")), ["label", "dim"])
        centered = some.join(near(centers), ["label", "dim"]).select("cls", "label", "dim", "v", "n", "sum")
        keyed = centered.mapInArrow(_keyed(range(start, start + together), bits, seed, kind), "pass int, label long, dim int, key binary, cls long, far double, v binary")
        ranked = global_rank(keyed, ["pass", "label", "dim", "key", "cls"], "v5-sorted")
        placed = ranked.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"rank div {block}L"), F.expr(f"(rank + {window}L) div {block}L")))))
        pairs = placed.groupBy("block").applyInArrow(_window_pairs(window, block, threshold, kind), "a long, b long, label long, dim int, n long, missed array<double>")
        found.append(written(pairs, "v5-pairs"))
        forget(ranked)
        if wanted is None:
            wanted = written(_passes(found[0], miss, passes), "v5-passes")
            last = wanted.agg(F.max("passes")).first()[0] or 0
        start += together
    edges = reduce(DataFrame.unionByName, found).where("a is not null").select("a", "b")
    comps = written(connected_components(edges, "a", "b", "v5"), "v5-components").select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    buckets = max(1, comps.count() // 2048)
    forget(*found)

    # of each component its vectors and smallest id, as a table: joins with it can be split
    parts = written(comps.join(classes.select("cls", "id"), "cls").groupBy("comp").agg(F.count("*").alias("n"), F.min("id").alias("lowest")), "v5-parts")
    inside = comps.join(parts.select("comp", "n"), "comp").join(classes.select("cls", "copies", "v"), "cls")
    inside = inside.withColumn("chunks", F.ceil(F.col("n") / chunk)).withColumn("own", F.pmod(F.xxhash64("cls"), "chunks"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    inside = inside.select(
        "cls", "comp", "copies", "v",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("comp"), F.lit(buckets))).otherwise(F.col("comp")).alias("g"),
        F.when(F.col("chunks") == 1, F.lit(-1)).otherwise(F.least("own", "other")).alias("i"),
        F.greatest("own", "other").alias("j"),
    )
    links = inside.groupBy("g", "i", "j").applyInArrow(_counts(threshold, kind), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    linked = comps.join(parts.select("comp", "lowest"), "comp").join(links, "cls").select("cls", "links", "lowest")
    by_class = classes.drop("v").join(linked, "cls", "left").select(
        *same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id")
    )
    out = good.select("id", *same).join(by_class, same).select("id", "n_links", "component_id")
    rest = rows.where("dim is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op5_sorted_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.x = e.vec_id
"""
