"""The assembly graph as tables, its adjacency, probes and filters.

Tables: nodes (node_id int, length int, cov_sum long, ends_fwd string, ends_twin string), arcs (begin_id, begin_fwd, end_id, end_fwd,
mult), noded_reads (node_id, read_id, offset, start_coord, fwd), reads (read_id, seq, pair_id). Oriented nodes are signed ids.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.trails import oriented


@dataclass(frozen=True)
class AssemblyGraph:
    nodes: DataFrame
    arcs: DataFrame
    k: int
    noded_reads: DataFrame | None = None
    reads: DataFrame | None = None
    unitigs: DataFrame | None = None  # (node_id, seq): whole sequences, where the graph was built here

    def edges(self) -> DataFrame:
        return oriented_edges(self.arcs)

    def edges_as_they_come(self) -> DataFrame:
        """The same in the tasks that hold the arcs; some may come twice."""
        a = self.arcs.select(oriented(F.col("begin_id"), F.col("begin_fwd")).alias("src"), oriented(F.col("end_id"), F.col("end_fwd")).alias("dst"))
        both = F.array(F.struct("src", "dst"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")))
        return a.select(F.explode(both).alias("e")).select("e.*")

    def coverage(self) -> DataFrame:
        return self.nodes.withColumn("coverage", F.col("cov_sum") / F.col("length"))


def oriented_edges(arcs: DataFrame) -> DataFrame:
    """(src, dst) signed: each arc read forwards and, both ends turned, backwards."""
    a = arcs.select(oriented(F.col("begin_id"), F.col("begin_fwd")).alias("src"), oriented(F.col("end_id"), F.col("end_fwd")).alias("dst"))
    return a.unionByName(a.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) for the oriented nodes in ``nodes`` (column src)."""
    return nodes.select("src").distinct().join(edges, "src")


def keep_nodes(graph: AssemblyGraph, kept: DataFrame) -> AssemblyGraph:
    """The graph on ``kept`` (column node_id); arcs and read placements that lose a node go."""
    ids = kept.select("node_id").distinct()
    arcs = graph.arcs.join(ids.withColumnRenamed("node_id", "begin_id"), "begin_id", "left_semi").join(ids.withColumnRenamed("node_id", "end_id"), "end_id", "left_semi")
    placed = graph.noded_reads.join(ids, "node_id", "left_semi") if graph.noded_reads is not None else None
    return replace(graph, nodes=graph.nodes.join(ids, "node_id", "left_semi"), arcs=arcs.select(*graph.arcs.columns), noded_reads=placed)


def coverage_filter(graph: AssemblyGraph, threshold: float, whitelist: DataFrame | None = None) -> AssemblyGraph:
    """Without nodes of lower coverage, but for those that hold a read of ``whitelist`` (column read_id)."""
    kept = graph.coverage().where(F.col("coverage") >= threshold).select("node_id")
    if whitelist is not None:
        kept = kept.union(graph.noded_reads.join(whitelist.select("read_id"), "read_id", "left_semi").select("node_id"))
    return keep_nodes(graph, kept)


def removed_by_coverage(graph: AssemblyGraph, threshold: float, whitelist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs) that ``coverage_filter`` takes away: nodes of too little coverage, and arcs that lose an end."""
    kept = coverage_filter(graph, threshold, whitelist)
    return graph.nodes.join(kept.nodes.select("node_id"), "node_id", "left_anti"), graph.arcs.join(kept.arcs, ["begin_id", "begin_fwd", "end_id", "end_fwd"], "left_anti")


def adjusted_position(offset: Column, length: Column, fwd: Column) -> Column:
    """Where a read begins on its node, from the node's start: reads of the other strand count from the end."""
    return F.when(fwd, offset).otherwise(length - offset)


def find_probes(noded_reads: DataFrame, probes: DataFrame, target_nodes: DataFrame | None = None) -> DataFrame:
    """(probe_idx, read_id, node_id, fwd, offset, start_coord): each probe read's node, the one where the read starts earliest; ties go
    to the smaller node; null where the read is on no node. ``target_nodes`` restricts the nodes looked at."""
    rows = noded_reads if target_nodes is None else noded_reads.join(target_nodes.select("node_id"), "node_id", "left_semi")
    rows = rows.join(probes.select("read_id").distinct(), "read_id", "left_semi")
    best = rows.groupBy("read_id").agg(F.min(F.struct("start_coord", "node_id", "offset", "fwd")).alias("b"))
    return probes.join(best, "read_id", "left").select("probe_idx", "read_id", "b.node_id", "b.fwd", "b.offset", "b.start_coord")


def missing_probes(found: DataFrame) -> DataFrame:
    """1-based numbers of the probes without a node."""
    return found.where("node_id is null").select((F.col("probe_idx") + 1).alias("probe_no"))


def initial_paths(found: DataFrame) -> DataFrame:
    return found.where("node_id is not null").select("probe_idx", oriented(F.col("node_id"), F.col("fwd")).alias("start"))


def adjusted_leash(found: DataFrame, leash: int) -> DataFrame:
    return found.withColumn("leash", F.col("offset") + F.lit(leash))


def probe_subset(found: DataFrame, numbers: list[int]) -> DataFrame:
    """The probes of the given 1-based numbers, renumbered in that order."""
    order = {n: i for i, n in enumerate(numbers)}
    wanted = found.sparkSession.createDataFrame([(n - 1, i) for n, i in order.items()], "probe_idx int, new_idx int")
    return found.join(F.broadcast(wanted), "probe_idx").drop("probe_idx").withColumnRenamed("new_idx", "probe_idx")  # as many rows as numbers given


def paired_nodes(noded_reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, mate_node_id): nodes whose reads have a mate there. pairs: (read_id, pair_id)."""
    mates = noded_reads.select("node_id", "read_id").distinct().join(pairs, "read_id")
    there = noded_reads.select(F.col("node_id").alias("mate_node_id"), F.col("read_id").alias("pair_id"))
    return mates.join(there, "pair_id").select("node_id", "mate_node_id").distinct()


def reads_by_name(reads: DataFrame, names: DataFrame) -> DataFrame:
    """(name, read_id): one or two reads (mates) for each name; other counts raise."""
    n = F.count("read_id").over(Window.partitionBy("name"))
    rows = names.select("name").distinct().join(reads.select("name", "read_id"), "name", "left")
    bad = F.raise_error(F.concat(F.lit("not one or two reads are named "), F.col("name"))).cast("long")
    return rows.select("name", F.when(n.between(1, 2), F.col("read_id")).otherwise(bad).alias("read_id"))


def nodes_with_kmers(nodes: DataFrame, kmers: DataFrame) -> DataFrame:
    """(ord, node_id, fwd): k-mers (ord, kmer) found in the strands of nodes. Equal lengths are looked up by equality of k-mers."""
    sizes = [r[0] for r in kmers.select(F.length("kmer")).distinct().collect()]  # a few lengths
    out = None
    for k in sizes:
        for side, fwd in (("ends_fwd", True), ("ends_twin", False)):
            at = F.when(F.length(side) >= k, F.sequence(F.lit(1), F.length(side) - k + 1)).otherwise(F.array().cast("array<int>"))
            rows = nodes.select("node_id", side, F.explode(at).alias("_p")).select("node_id", F.expr(f"substr({side}, _p, {k})").alias("kmer"), F.lit(fwd).alias("fwd")).distinct()
            hit = rows.join(kmers.where(F.length("kmer") == k), "kmer").select("ord", "node_id", "fwd")
            out = hit if out is None else out.unionByName(hit)
    return out


def unique_node_by_kmers(nodes: DataFrame, kmers: DataFrame) -> DataFrame:
    """(ord, node_id, fwd) of the first k-mer that stands on exactly one strand of exactly one node."""
    hits = nodes_with_kmers(nodes, kmers)
    one = hits.groupBy("ord").agg(F.count("*").alias("n"), F.first("node_id").alias("node_id"), F.first("fwd").alias("fwd")).where("n = 1")
    return one.groupBy().agg(F.min(F.struct("ord", "node_id", "fwd")).alias("b")).where("b is not null").select("b.*")


def nodes_by_kmers(nodes: DataFrame, kmers: DataFrame) -> DataFrame:
    """(node_id): the node of the first k-mer (ord, kmer) that only one node has, on either strand; where there is none, all nodes of the last k-mer that any has."""
    hits = nodes_with_kmers(nodes, kmers).select("ord", "node_id").distinct()
    counts = hits.groupBy("ord").agg(F.count("*").alias("n"))
    chosen = counts.agg(F.coalesce(F.min(F.when(F.col("n") == 1, F.col("ord"))), F.max("ord")).alias("ord"))  # one row
    return hits.join(F.broadcast(chosen), "ord", "left_semi").select("node_id")


def trail_sequences(paths: DataFrame, nodes: DataFrame, k: int, path_id: str = "path_id", path: str = "path") -> DataFrame:
    """(path_id, seq): the k-1 bases before the first node's k-mers, from the other strand, and then every node's bases.
    Raises where the path is shorter than k-1; an empty path has an empty sequence."""
    steps = paths.select(path_id, F.posexplode(path).alias("_i", "_n"))
    rows = steps.join(nodes.select("node_id", "ends_fwd", "ends_twin"), F.abs("_n") == F.col("node_id"), "left")
    ahead, back = F.when(F.col("_n") > 0, F.col("ends_fwd")).otherwise(F.col("ends_twin")), F.when(F.col("_n") > 0, F.col("ends_twin")).otherwise(F.col("ends_fwd"))
    whole = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), "")
    both = rows.groupBy(path_id).agg(
        whole(F.array_sort(F.collect_list(F.struct(F.col("_i"), ahead.alias("s"))))).alias("_f"),
        whole(F.array_sort(F.collect_list(F.struct((-F.col("_i")).alias("_i"), back.alias("s"))))).alias("_t"),
    )
    before = F.substring(F.reverse(F.translate("_t", "ACGT", "TGCA")), 1, k - 1)
    seq = F.when(F.length("_t") >= k - 1, F.concat(before, F.col("_f"))).otherwise(F.raise_error(F.lit("the path is shorter than k - 1")).cast("string"))
    return paths.select(path_id).join(both.select(path_id, seq.alias("seq")), path_id, "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def trail_coverage(paths: DataFrame, nodes: DataFrame, path_id: str = "path_id", path: str = "path") -> DataFrame:
    """(path_id, coverage, length_in_bp_within_path): length-weighted mean coverage."""
    rows = paths.select(path_id, F.explode(path).alias("_n")).join(nodes.select("node_id", "length", "cov_sum"), F.abs("_n") == F.col("node_id"))
    return rows.groupBy(path_id).agg((F.sum("cov_sum") / F.sum("length")).alias("coverage"), F.sum("length").alias("bp"))


def best_covered(paths: DataFrame, nodes: DataFrame, group: str, path_id: str = "path_id", path: str = "path") -> DataFrame:
    """(group, path_id): the path of the highest mean coverage of each group; ties go to the smaller id."""
    rows = paths.select(group, path_id).join(trail_coverage(paths, nodes, path_id, path), path_id)
    return rows.groupBy(group).agg(F.min(F.struct((-F.col("coverage")).alias("c"), F.col(path_id))).alias("b")).select(group, F.col(f"b.{path_id}").alias(path_id))


def broken_steps(paths: DataFrame, edges: DataFrame, path_id: str = "path_id", path: str = "path") -> DataFrame:
    """(path_id, src, dst): steps of the paths that no edge allows."""
    n = F.size(path)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(path, 1, n - 1).alias("src"), F.slice(path, 2, n - 1).alias("dst")))
    rows = paths.select(path_id, F.explode(pairs).alias("s")).select(path_id, "s.src", "s.dst")
    return rows.join(edges, ["src", "dst"], "left_anti")


def orient_ids(paths: DataFrame, edges: DataFrame, path_id: str = "path_id", ids: str = "ids") -> DataFrame:
    """(path_id, path): signed paths for lists of unsigned ids; lists that fit no orientation or more than one raise.
    The two orientations of each position are carried along the list, so a list is one row's work."""
    spans = paths.select(path_id, ids, F.posexplode(ids).alias("_i", "_a")).withColumn("_b", F.lead("_a").over(Window.partitionBy(path_id).orderBy("_i"))).where("_b is not null")
    steps = spans.join(edges.select("src", "dst", F.abs("src").alias("_a"), F.abs("dst").alias("_b")), ["_a", "_b"], "left")
    allowed = steps.groupBy(path_id, "_i").agg(F.collect_set(F.struct("src", "dst")).alias("ok")).groupBy(path_id).agg(F.array_sort(F.collect_list(F.struct("_i", "ok"))).alias("steps"))
    rows = paths.select(path_id, ids).join(allowed, path_id, "left")
    walked = F.expr(f"""
      aggregate(coalesce(steps, array()), array(array({ids}[0]), array(-{ids}[0])),
        (acc, s) -> flatten(transform(acc, p -> transform(filter(s.ok, e -> e.src = element_at(p, -1)), e -> array_append(p, e.dst)))))""")
    rows = rows.withColumn("_w", F.when(F.size(ids) > 1, walked).when(F.size(ids) == 1, F.array(F.col(ids))).otherwise(F.array(F.array().cast("array<int>"))))
    bad = F.raise_error(F.concat(F.lit("not one orientation fits path "), F.col(path_id).cast("string"))).cast("array<int>")
    return rows.select(path_id, F.when(F.size("_w") == 1, F.col("_w")[0]).otherwise(bad).alias("path"))
