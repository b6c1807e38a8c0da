"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Vectors become integers (floor of ``scale`` times each component, in double precision) and are dealt to blocks. A block's index holds, for each
quantised impact (the magnitude of a component over the block's ``levels`` steps), the posting segments of all dimensions at that impact; the
segments are processed from the highest impact down, for many queries at a time, into accumulators. After each impact the part of every vector that
isn't in its accumulator has a known length, so by Cauchy and Schwarz a score lies within |query| times that length of the accumulator: vectors whose upper
bound is below the k-th best lower bound can't be members. A query stops once those that may be are few, or the segments end, and exactly
those are scored with all their components; its answer is proven either way, whatever the data.

Queries meet every block in a grid of cells (query group, block): blocks and groups are bounded in bytes, each cell gives k rows a query, and
the best k of those are the result. A row is no candidate of itself only; equal vectors and rows that share an id are candidates like others.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or candidates; vectors of different lengths are
not compared; rows without an id are candidates, after the others at equal scores, and no queries; repeated rows are rows of their own, so a
repeated query id has the answers of each of its rows; a score beyond a long is the nearest long; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, written

_LONG = np.iinfo(np.int64)


def _read(kind: str):
    """(id, v binary) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and not v.values.null_count else None
                raw.append(x.tobytes() if x is not None and np.isfinite(x).all() else None)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "v"])
            yield out.filter(out.column(1).is_valid())

    return run


def _integers(parts: list, kind: str, scale: float) -> np.ndarray:
    """Floor of scale times each component; Python integers where doubles don't hold them exactly."""
    x = np.frombuffer(b"".join(parts), kind).astype(np.float64).reshape(len(parts), -1)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2**53:
        return y
    return np.array([[int(v * scale) if np.isfinite(v * scale) else int(v) * int(scale) for v in row] for row in x], object)


class ImpactIndex:
    """The posting segments of a block of integer vectors, by descending quantised impact."""

    def __init__(self, rows: np.ndarray, levels: int):
        self.rows, size = rows, np.abs(rows)
        self.width = max(2.0, 2 * np.ceil((size.max() + 1) / levels / 2)) if rows.size else 2.0
        level = (size // self.width).astype(np.int16)
        rest = (rows * rows).sum(axis=1)
        self.segments = []  # (vector, dimension, quantised component) of an impact, and the length that is left of every vector
        for impact in range(levels, 0, -1):
            vec, dim = np.nonzero(level == impact)
            if not len(vec):
                continue
            true = rows[vec, dim]
            held = np.sign(true) * (impact + 0.5) * self.width
            rest = rest + np.bincount(vec, (true - held) ** 2 - true**2, len(rows))
            self.segments.append((vec, dim, held, np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6))
        self.whole = np.sqrt((rows * rows).sum(axis=1)) * (1 + 1e-9) + 1e-6

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, few: int) -> list[np.ndarray]:
        """For each query the vectors that may be among its k best, its ``own`` (-1: none) left out: all members are among them."""
        n = len(self.rows)
        found: list = [None] * len(queries)
        live, acc = np.arange(len(queries)), np.zeros((len(queries), n))
        length = np.sqrt((queries * queries).sum(axis=1)) * (1 + 1e-9)
        steps = [*self.segments, None]
        for at, step in enumerate(steps):
            if step is None:
                rest = self.segments[-1][3] if self.segments else self.whole
            else:
                vec, dim, held, rest = step
                plane = np.zeros((n, queries.shape[1]))
                plane[vec, dim] = held
                acc += queries[live] @ plane.T
            slack = length[live][:, None] * rest[None, :] + 1e-9 * np.abs(acc)
            low, high = acc - slack, acc + slack
            mine = np.flatnonzero(own[live] >= 0)
            low[mine, own[live][mine]] = high[mine, own[live][mine]] = -np.inf
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
            may = (high >= floor[:, None]) & (high > -np.inf)
            done = (may.sum(axis=1) <= few) | (step is None)
            for i in np.flatnonzero(done):
                found[live[i]] = np.flatnonzero(may[i])
            live, acc = live[~done], acc[~done]
            if not len(live):
                break
        return found


def _ranked(scores: np.ndarray, ids: list, k: int) -> list[int]:
    """Places of the k best scores, ties to the smaller id, none last."""
    if len(scores) > 4 * k:  # all that reach the k-th best
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return sorted(at.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]


def _cell(kind: str, scale: float, k: int, levels: int, few: int, together: int):
    item = np.dtype(kind).itemsize

    def run(table):
        asked, raw = np.array(table.column("asked").to_pylist(), bool), table.column("v").to_pylist()
        ids, row = table.column("id").to_pylist(), table.column("row").to_numpy()
        dims = np.array([len(v) // item for v in raw])
        out: list[tuple] = []
        for dim in np.unique(dims[asked]):
            q, c = np.flatnonzero(asked & (dims == dim)), np.flatnonzero(~asked & (dims == dim))
            if not len(c):
                continue
            qs, rows = _integers([raw[i] for i in q], kind, scale), _integers([raw[i] for i in c], kind, scale)
            place = {r: i for i, r in enumerate(row[c].tolist())}
            own = np.array([place.get(r, -1) for r in row[q].tolist()])
            names = [ids[i] for i in c]
            plain = qs.dtype != object and rows.dtype != object and dim * np.abs(qs).max(initial=0) * np.abs(rows).max(initial=0) < 2**52
            index = ImpactIndex(rows, levels) if plain and dim else None
            for start in range(0, len(q), together):
                part = slice(start, start + together)
                if index is not None:
                    may = index.search(qs[part], own[part], k, few)
                else:  # no bounds in doubles: every vector is scored
                    may = [np.array([i for i in range(len(c)) if i != o], int) for o in own[part]]
                for i, at in zip(range(start, len(q)), may):
                    if plain:
                        scores = rows[at] @ qs[i]
                    else:
                        scores = np.array([max(_LONG.min, min(_LONG.max, sum(int(x) * int(y) for x, y in zip(rows[j], qs[i])))) for j in at], object)
                    for j in _ranked(scores, [names[x] for x in at], k) if len(at) else ():
                        out.append((ids[q[i]], int(row[q[i]]), names[at[j]], int(scores[j])))
        names = ["query_id", "query_row", "vec_id", "score"]
        return pa.table({name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate(names)})

    return run


def top_inner_products(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0, levels: int = 16,
    few: int = 64, together: int = 32, block_bytes: int = 1 << 24, least: int = 1024,
) -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): the ``k`` highest integer inner products of each row for which ``is_query``, a condition on ``id``, holds with all other rows.
    ``block_bytes`` bounds a block and a group of queries, ``together`` the queries that share accumulators; ``few`` candidates end a search."""
    spark = vectors.sparkSession
    items = vectors.schema[vec_col].dataType.elementType.typeName()
    kind, given = ("<f4", F.col(vec_col)) if items == "float" else ("<f8", F.col(vec_col).cast("array<double>"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), given.alias("v")).mapInArrow(_read(kind), "id long, v binary")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "k11-rows")
    ask = F.coalesce(F.expr("id is not null") & is_query, F.lit(False))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(ask, 1)).alias("q"), F.max(F.octet_length("v")).alias("most")).first()
    whole = max(1, block_bytes // max(8, size["most"] or 0))  # rows of a full block
    blocks = max(1, -(-size["n"] // whole), min(2 * parallelism(spark), size["n"] // least))
    groups = max(1, -(-size["q"] // whole))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("row", "id", "v", F.lit(False).alias("asked"), deal(blocks).alias("block")).withColumn("group", every(groups))
    posed = rows.where(ask).select("row", "id", "v", F.lit(True).alias("asked"), deal(groups).alias("group")).withColumn("block", every(blocks))
    cells = held.unionByName(posed).groupBy("group", "block")
    found = cells.applyInArrow(_cell(kind, scale, k, levels, few, together), "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def op11_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


OP11_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
