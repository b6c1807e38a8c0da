"""Set-like traversals of the oriented graph: rounds of joins, each round a written table.

Distances: the start counts 0 and its own length nothing, so its neighbours are at 0; every node left after that adds its length.
A result is what lies within the leash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.lineage import bounded, connected_components, dealt, forget, measured, written

_UNFINISHED = "the traversal isn't finished after so many rounds"
_BROADCAST = 1_000_000  # rows of two numbers


class _Grown:
    """Rows that come round by round, each round a written table; many tables become one now and then."""

    def __init__(self, tag: str, most: int = 24):
        self.tag, self.most, self.parts = tag, most, []

    def add(self, part: DataFrame) -> None:
        if len(self.parts) >= self.most:  # the part that comes now stays a table of its own, as it is read on
            old, self.parts = self.parts, [written(self.all(), self.tag)]
            forget(*old)
        self.parts.append(part)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def _lengths(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("_id"), F.col("length").cast("long").alias("_len"))


def min_distances(
    edges: DataFrame, nodes: DataFrame, starts: DataFrame, leash: int | None = None, ignore_directions: bool = False,
    max_nodes: int | None = None, far_edges: DataFrame | None = None, rounds: int = 10_000,
) -> DataFrame:
    """(source, node, dist) from starts (source, start). Edges may come more than once.

    Of the edges only those are kept whose node can be left: a start, or one that is no longer than the leash.
    ``ignore_directions``: a node may be left by either side and both sides are reported with the smaller distance.
    ``far_edges`` (src, dst, gap): neighbours at a further distance, below 0 counting as 0. ``max_nodes``: only the nearest so many
    node ids beyond the start, with all ties of the last."""
    steps = edges.select("src", "dst", F.lit(0).cast("long").alias("gap"))
    if far_edges is not None:
        steps = steps.unionByName(far_edges.select("src", "dst", F.greatest(F.col("gap").cast("long"), F.lit(0).cast("long")).alias("gap")))
    if ignore_directions:
        flipped = steps.select((-F.col("src")).alias("src"), "dst", "gap")
        steps = steps.unionByName(flipped)
        steps = steps.unionByName(steps.select("src", (-F.col("dst")).alias("dst"), "gap"))
    count = F.count(F.lit(1))
    left = _lengths(nodes)
    if leash is not None:
        first = starts.select(F.abs("start").alias("_id"), F.lit(True).alias("_first")).distinct()
        left = left.join(first, "_id", "left").where((F.col("_len") <= leash) | F.col("_first")).drop("_first")
    left = written(left, "dist-left")
    steps = steps.join(F.broadcast(left) if bounded(left, _BROADCAST) else left, F.abs("src") == F.col("_id")).select("src", "dst", "_len", "gap")
    given, seen = measured(steps, "dist-given", n=count)
    steps = written(dealt(given, seen["n"], "src", "dst").groupBy("src", "dst", "_len").agg(F.min("gap").alias("gap")), "dist-steps")
    forget(given, left)
    limit = F.lit(True) if leash is None else F.col("dist") <= leash
    seed = starts.select("source", F.explode(F.array("start", -F.col("start")) if ignore_directions else F.array("start")).alias("node")).distinct()
    (front, new), seen = measured(seed.withColumn("dist", F.lit(0).cast("long")), "dist", n=count), _Grown("dist-seen")
    seen.add(front)
    rows = new["n"]
    cost = F.lit(0).cast("long")  # of leaving a start
    for _ in range(rounds):
        found = front.join(steps, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("gap") + cost).alias("dist")).where(limit)
        found = written(found.groupBy("source", "node").agg(F.min("dist").alias("dist")), "dist-found")
        # only what is known of the nodes just found is read again
        known = seen.all().join(found.select("source", "node"), ["source", "node"], "left_semi").groupBy("source", "node").agg(F.min("dist").alias("_old"))
        front, new = measured(found.join(known, ["source", "node"], "left").where("_old is null or dist < _old").select("source", "node", "dist"), "dist", n=count)
        forget(found)
        if not new["n"]:
            break
        seen.add(front)
        rows += new["n"]
        cost = F.col("_len")
    else:
        raise RuntimeError(_UNFINISHED)
    out = dealt(seen.all(), rows, "source", "node").groupBy("source", "node").agg(F.min("dist").alias("dist"))
    if max_nodes is not None:
        ids = out.groupBy("source", F.abs("node").alias("_a")).agg(F.min("dist").alias("_d"))
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("_d", "_a")))
        cut = ids.where(F.col("_r") <= max_nodes + 1).groupBy("source").agg(F.max("_d").alias("_cut"))
        out = out.join(cut, "source").where(F.col("dist") <= F.col("_cut")).drop("_cut")
    return out


def both_ways(starts: DataFrame) -> DataFrame:
    """Starts from both sides of each node."""
    return starts.select("source", F.explode(F.array("start", -F.col("start"))).alias("start"))


def distances_both_ways(edges: DataFrame, nodes: DataFrame, starts: DataFrame, leash: int | None = None, **options) -> DataFrame:
    """(source, node, dist), the smaller of the distances from the two sides of each start."""
    return min_distances(edges, nodes, both_ways(starts), leash, **options)


def nodes_within_leash(edges: DataFrame, nodes: DataFrame, starts: DataFrame, leash: int, far_edges: DataFrame | None = None) -> DataFrame:
    """(node_id, boundary): nodes within the leash of any start, either way; boundary where a neighbour is outside."""
    near = distances_both_ways(edges, nodes, starts, leash, far_edges=far_edges).select(F.abs("node").alias("node_id")).distinct()
    near = written(near, "within")
    out = edges.select(F.abs("src").alias("node_id"), F.abs("dst").alias("_to")).distinct().join(near, "node_id", "left_semi")
    out = out.join(near.withColumnRenamed("node_id", "_to"), "_to", "left_anti").select("node_id").distinct().withColumn("_out", F.lit(True))
    return near.join(out, "node_id", "left").select("node_id", F.coalesce("_out", F.lit(False)).alias("boundary"))


def connected_to(edges: DataFrame, nodes: DataFrame, whitelist: DataFrame, leash: int | None = None) -> DataFrame:
    """(node_id): whitelisted nodes and all that are connected to them whatever the direction, within the leash if one is given."""
    if leash is not None:
        starts = whitelist.select(F.col("node_id").alias("source"), F.col("node_id").alias("start"))
        found = min_distances(edges, nodes, starts, leash, ignore_directions=True).select(F.abs("node").alias("node_id"))
        return found.union(whitelist.select("node_id")).distinct()
    comps = connected_components(edges.select(F.abs("src").alias("a"), F.abs("dst").alias("b")), "a", "b", "connected")
    named = nodes.select("node_id").join(comps.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    named = written(named, "connected-named")
    wanted = named.join(whitelist.select("node_id"), "node_id", "left_semi").select("component").distinct()
    return named.join(wanted, "component", "left_semi").select("node_id")


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node): oriented nodes that walks from starts (column node) reach, the starts included."""
    front, seen = written(starts.select("node").distinct(), "reach"), _Grown("reach-seen")
    for _ in range(rounds):
        seen.add(front)
        found = written(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "reach-found")
        known = seen.all().join(found, "node", "left_semi")
        front = written(found.join(known, "node", "left_anti"), "reach")
        forget(found)
        if not front.limit(1).count():
            break
    else:
        raise RuntimeError(_UNFINISHED)
    return seen.all()


def explore(edges: DataFrame, nodes: DataFrame, starts: DataFrame, k: int, leash: int, rounds: int = 10_000) -> DataFrame:
    """(source, path, fate): all acyclic paths from starts (source, start), each until it is longer than the leash in bp ('Leashed'), ends
    ('Dead end / coverage') or comes back to a node of its own ('Loop', the repeated node included)."""
    steps = written(edges.join(_lengths(nodes), F.abs("dst") == F.col("_id")).select("src", "dst", "_len"), "explore-steps")
    first = starts.select("source", "start").join(_lengths(nodes), F.abs("start") == F.col("_id"))
    live = first.select("source", F.array("start").alias("path"), (F.col("_len") + (k - 1)).alias("bp"), F.when(F.col("_len") + (k - 1) > leash, "Leashed").alias("fate"))
    done, live = live.where("fate is not null"), written(live.where("fate is null"), "explore")
    for _ in range(rounds):
        ext = live.join(steps, F.element_at("path", -1) == F.col("src"), "left")
        ext = ext.select(
            "source", F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("dst"))).alias("path"),
            (F.col("bp") + F.coalesce("_len", F.lit(0))).alias("bp"),
            F.when(F.col("dst").isNull(), "Dead end / coverage").when(F.expr("array_contains(path, dst)"), "Loop").when(F.col("bp") + F.col("_len") > leash, "Leashed").alias("fate"),
        )
        ext = written(ext, "explore")
        done = done.unionByName(ext.where("fate is not null"))
        live = ext.where("fate is null")
        if not live.limit(1).count():
            break
    else:
        raise RuntimeError(_UNFINISHED)
    return done.select("source", "path", "fate")


def _read_back(leash: int):
    """For one pair's rows (kind, a, b, rest, w), steps of kind 0 and the pair of kind 1, its acyclic paths one by one."""

    def run(name: str, rows: list[tuple]) -> Iterator[tuple]:
        on = defaultdict(list)
        for kind, a, b, rest, w in rows:
            if not kind:
                on[a].append((b, rest, w))
        for start, stop in [(a, b) for kind, a, b, _, _ in rows if kind]:
            stack = [([start], 0)]
            while stack:
                path, bp = stack.pop()
                if path[-1] == stop:
                    yield name, path
                    continue
                stack += [([*path, m], bp + w) for m, rest, w in on.get(path[-1], ()) if m not in path and bp + w + rest <= leash]

    return run


def _paths_in_rounds(steps: DataFrame, ends: DataFrame, leash: int, rounds: int) -> DataFrame:
    """(pair_id, path): the same in rounds of joins."""
    live = written(ends.select("pair_id", "stop", F.array("start").alias("path"), F.lit(0).cast("long").alias("bp")), "paths")
    done = live.where("element_at(path, -1) = stop")
    for _ in range(rounds):
        on = live.where("element_at(path, -1) != stop").withColumn("src", F.element_at("path", -1))
        ext = on.join(steps, ["pair_id", "src"]).where("not array_contains(path, dst)").where(F.col("bp") + F.col("_len") + F.col("rest") <= leash)
        ext = ext.select("pair_id", "stop", F.array_append("path", F.col("dst")).alias("path"), (F.col("bp") + F.col("_len")).alias("bp"))
        live, seen = measured(ext, "paths", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        done = done.unionByName(live.where("element_at(path, -1) = stop"))
    else:
        raise RuntimeError(_UNFINISHED)
    return done.select("pair_id", "path")


def paths_between(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, leash: int, max_paths: int | None = 2196, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Acyclic paths for pairs (pair_id, start, stop) whose node lengths before the last add up to the leash at most: (pair_id, path), and
    (pair_id, max_paths_exceeded). A pair with more than ``max_paths`` has none. Paths are read back from the steps that lead to their goal within the leash."""
    from strandflow.operators.programme import pairs_of_size, path_steps
    from strandflow.operators.streams import in_groups

    ends = pairs.select("pair_id", "start", "stop")
    steps = path_steps(edges, nodes, ends, leash).join(_lengths(nodes), F.abs("src") == F.col("_id")).select("pair_id", "src", "dst", "rest", "_len")
    steps = written(steps, "paths-steps")
    few, many = pairs_of_size(steps, min(rounds, 10_000))
    name, kind = ends.schema["pair_id"].dataType.simpleString(), ends.schema["start"].dataType.simpleString()
    mine = ends if many is None else ends.join(many.select("pair_id").distinct(), "pair_id", "left_anti")
    none = F.lit(0).cast("long")
    row = lambda df, n, a, b, rest, w: df.select(F.col("pair_id").cast("string").alias("pair"), F.lit(n).alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), rest.alias("rest"), w.alias("w"))
    rows = row(few, 0, "src", "dst", F.col("rest"), F.col("_len")).unionByName(row(mine, 1, "start", "stop", none, none))
    done = in_groups(rows, _read_back(leash), f"pair string, path array<{kind}>").select(F.col("pair").cast(name).alias("pair_id"), "path")
    if many is not None:
        theirs = written(many, "paths-many")
        done = done.unionByName(_paths_in_rounds(theirs, ends.join(theirs.select("pair_id").distinct(), "pair_id", "left_semi"), leash, rounds))
    if max_paths is None:
        return done, pairs.select("pair_id", F.lit(False).alias("max_paths_exceeded"))
    done = written(done, "paths-done")
    over = done.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > max_paths).select("pair_id")
    status = pairs.select("pair_id").join(over.withColumn("_o", F.lit(True)), "pair_id", "left").select("pair_id", F.coalesce("_o", F.lit(False)).alias("max_paths_exceeded"))
    return done.join(over, "pair_id", "left_anti"), status


def range_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind): where walks through the nodes (column node_id) begin ('start') and end ('end'). The range is read in one orientation: of each
    connected part the one that has its smallest node forwards; parts that can be read both ways at once are given in both."""
    ids = nodes.select("node_id").distinct()
    inner = edges.join(ids, F.abs("src") == F.col("node_id"), "left_semi").join(ids, F.abs("dst") == F.col("node_id"), "left_semi")
    inner = written(inner, "range-edges")
    signed = ids.select(F.explode(F.array("node_id", -F.col("node_id"))).alias("node"))
    comps = connected_components(inner, "src", "dst", "range")
    named = signed.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "range-named")
    lead = named.groupBy("component").agg(F.min_by("node", F.struct(F.abs("node"), -F.col("node"))).alias("_lead")).where("_lead > 0").select("component")
    read = named.join(lead, "component", "left_semi").select("node")
    begin = read.join(inner.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit("start").alias("kind"))
    end = read.join(inner.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.lit("end").alias("kind"))
    return begin.unionByName(end)


def leash_starts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): where walks through the nodes begin; where none does, as on a ring, the smallest node forwards."""
    found = written(range_edges(edges, nodes).where("kind = 'start'").select("node"), "leash-starts")
    if found.limit(1).count():
        return found
    return nodes.agg(F.min("node_id").alias("node")).where("node is not null")
