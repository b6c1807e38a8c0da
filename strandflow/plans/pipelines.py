"""The questions asked of an assembly as whole queries: from files or tables to results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.sequence import revcomp
from strandflow.functions.trails import oriented
from strandflow.lineage import global_rank, written
from strandflow.operators import cycles as cy
from strandflow.operators import graph as gr
from strandflow.operators import orfs as of
from strandflow.operators import scaffolds as sc
from strandflow.operators import traverse as tv
from strandflow.operators import variants as va
from strandflow.operators import walkers as wk
from strandflow.operators.alignment import aligned
from strandflow.operators.build import build_graph
from strandflow.operators.graph import AssemblyGraph


def probed_graph(reads: DataFrame, probes: DataFrame, k: int = 51, coverage_cutoff: float = 3.5, post_assembly_coverage_cutoff: float | None = None) -> tuple[AssemblyGraph, DataFrame]:
    """(graph, found): the graph of reads (read_id, seq) and probes (probe_no, seq), and each probe's node; reads' ids follow the probes'. A cutoff after the
    assembly takes away nodes of less coverage, but not those that hold a probe."""
    n = probes.count()
    p = probes.select(F.col("probe_no").cast("long").alias("read_id"), "seq")
    g = build_graph(reads.select((F.col("read_id") + n + 1).cast("long").alias("read_id"), "seq"), k, coverage_cutoff, p)
    if post_assembly_coverage_cutoff is not None:
        g = gr.coverage_filter(g, post_assembly_coverage_cutoff, p)
    found = gr.find_probes(g.noded_reads, p.select((F.col("read_id") - 1).alias("probe_idx"), "read_id"))
    return g, found


def wander(
    scaffolds: DataFrame, reads: DataFrame, k: int = 51, coverage_cutoff: float = 3.5, overhang: int = 200, leash: int = 20_000, recoherence: int | None = 1,
    unscaffold_first: bool = False, proceed_on_short_contigs: bool = False,
) -> dict[str, DataFrame]:
    """Which contig ends connect, how far apart, and the scaffolds that follow: connections (seq1, side1, seq2, side2, distance) and members.

    Scaffolds: (scaffold_idx, name, seq); with ``unscaffold_first`` their contigs are connected instead, numbered as ``sequences`` (seq, name). Sequences shorter than two overhangs raise, or
    with ``proceed_on_short_contigs`` have no probes and stay members of their own. A distance spans from probe start to probe start along the graph, less k."""
    if unscaffold_first:
        broken = sc.contig_names(sc.break_scaffolds(scaffolds)).select(F.col("contig_name").alias("name"), "seq", "scaffold_idx", "start")
        rows = global_rank(broken, ["scaffold_idx", "start"], "wander-contigs").select(F.col("rank").alias("scaffold_idx"), "name", "seq")
    else:
        rows = scaffolds.select("scaffold_idx", "name", "seq")
    rows = written(rows, "wander-sequences")
    short = rows.where(F.length("seq") < 2 * overhang).limit(1).collect()
    if short and not proceed_on_short_contigs:
        raise ValueError(f"sequence {short[0]['name']} is shorter than two overhangs of {overhang} bases")
    contigs = rows.select("scaffold_idx", F.lit(0).alias("contig_idx"), "seq").where(F.length("seq") >= 2 * overhang)
    probes = sc.end_probes(contigs, overhang)
    g, found = probed_graph(reads, probes, k, coverage_cutoff)
    named = found.join(probes.select((F.col("probe_no") - 1).alias("probe_idx"), "scaffold_idx", "side"), "probe_idx").where("node_id is not null")
    near = connections_between(g, named, leash, recoherence)
    c = near.select("seq1", "side1", "seq2", "side2", "distance")
    members = sc.chains(rows.select(F.col("scaffold_idx").cast("long").alias("seq")), sc.canonical_connections(c))
    return {"connections": c, "members": members, "sequences": rows.select(F.col("scaffold_idx").alias("seq"), "name")}


def connections_between(g: AssemblyGraph, probes: DataFrame, leash: int, recoherence: int | None = None, largest: int = 100_000) -> DataFrame:
    """(seq1, side1, seq2, side2, distance) for probes (probe_idx, node_id, fwd, offset, scaffold_idx, side): each connected part of the graph is walked by one
    task; bases of a probe's node that its read doesn't reach are added on both sides, k taken off."""
    at = probes.select("probe_idx", oriented(F.col("node_id"), F.col("fwd")).alias("node"), F.coalesce("offset", F.lit(0)).alias("offset"))
    k = g.k

    def walk(lg: wk.LocalGraph) -> Iterable[tuple]:
        mine = sorted(lg.probes)
        near = wk.wander(lg, [lg.probes[p][0] for p in mine], leash, recoherence, only=[mine.index(p) for p in lg.asked()])
        facing, asked = {}, set(lg.asked())
        for i, p in enumerate(mine):  # two probes that face each other on one node
            node, off = lg.probes[p]
            near.update({(j, i): 0 for j in facing.get(-node, ()) if mine[j] in asked and lg.probes[mine[j]][1] + off <= lg.length[abs(node)]})
            facing.setdefault(node, []).append(i)
        out = []
        for (i, j), d in near.items():
            (s, off1), (_, off2) = lg.probes[mine[i]], lg.probes[mine[j]]
            total = d + (lg.length[abs(s)] - off1) - off2 - k
            if i != j and total <= leash:
                out.append((mine[i], mine[j], int(total)))
        return out

    found = wk.per_component(g, walk, "p1 long, p2 long, distance long", probes=at, leash=leash, largest=largest)
    side = lambda n: probes.select(F.col("probe_idx").alias(f"p{n}"), F.col("scaffold_idx").cast("long").alias(f"seq{n}"), F.col("side").alias(f"side{n}"))
    return found.join(side(1), "p1").join(side(2), "p2")


def gap_paths(g: AssemblyGraph, ends: DataFrame, leash: int = 20_000, max_cycles: int = 1, max_paths: int | None = 2196, max_explore_nodes: int | None = None, recoherence: int | None = None, largest: int = 100_000) -> DataFrame:
    """(gap_id, path, exceeded) for ends (gap_id, start, stop) as signed nodes; a gap beyond a cap has one row without a path."""
    def walk(lg: wk.LocalGraph) -> Iterable[tuple]:
        out = []
        for gap, (a, b) in sorted(lg.gaps.items()):
            if abs(b) in lg.length:
                s = wk.paths_between(lg, a, b, leash, max_cycles, max_paths, max_explore_nodes, recoherence)
                out += [(gap, p, False) for p in s.paths] or ([(gap, None, True)] if s.max_path_limit_exceeded else [])
        return out

    return wk.per_component(g, walk, "gap_id long, path array<int>, exceeded boolean", gaps=ends, leash=leash, largest=largest)


def fills(g: AssemblyGraph, gaps: DataFrame, leash: int = 20_000, max_paths: int = 10, max_coverage: bool = False, max_cycles: int = 1, max_explore_nodes: int | None = None, recoherence: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What stands between two probes, (gap_id, paths, fill), and the variants that its paths imply, (gap_id, pos, type, seq, del_len), for gaps
    (gap_id, start, stop as signed nodes, left, right, left_at, right_at): the probe before the gap and the reverse complement of the one behind it, and how many bases of the first node stand ahead of the
    one and of the last node behind the other.

    A gap is filled where 1 to ``max_paths`` paths are found and each holds both probes at their places, one after the other: by the only path, by the best covered
    one with ``max_coverage``, or by the consensus of all, N where they differ and nothing where most have a gap."""
    paths = gap_paths(g, gaps.select("gap_id", "start", "stop"), leash, max_cycles, max_paths, max_explore_nodes, recoherence).where("path is not null")
    paths = written(global_rank(paths, ["gap_id", "path"], "fill-sorted", "path_id"), "fill-paths")
    if max_coverage:
        paths = paths.join(gr.best_covered(paths, g.nodes, "gap_id"), ["gap_id", "path_id"], "left_semi")
    size = gr.trail_coverage(paths, g.nodes).where(F.col("bp") >= g.k - 1).select("path_id")  # a shorter path has no sequence
    seqs = gr.trail_sequences(paths.join(size, "path_id", "left_semi"), g.nodes, g.k)
    rows = paths.join(seqs, "path_id", "left").join(gaps.select("gap_id", "left", "right", "left_at", "right_at"), "gap_id")
    rows = rows.withColumn("_from", F.col("left_at") + F.length("left")).withColumn("_to", F.length("seq") - F.col("right_at") - F.length("right"))
    held = "_from <= _to and substr(seq, cast(left_at + 1 as int), length(left)) = left and substr(seq, cast(_to + 1 as int), length(right)) = right"
    rows = rows.select("gap_id", "path_id", F.when(F.expr(held), F.expr("substr(seq, cast(_from + 1 as int), cast(_to - _from as int))")).alias("fill"))
    rows = written(rows, "fill-candidates")
    found = rows.groupBy("gap_id").agg(F.count("*").alias("paths"), F.count("fill").alias("whole"), F.min("fill").alias("one"), F.max("fill").alias("other")).where("paths = whole")
    same = found.where("one = other").select("gap_id", "paths", F.col("one").alias("fill"))
    several = found.where("one != other").select("gap_id", "paths")
    al = written(aligned(rows.join(several, "gap_id", "left_semi"), "gap_id", "path_id", "fill"), "fill-aligned")
    agreed = va.consensus(al, "gap_id")
    merged = several.join(agreed, "gap_id").select("gap_id", "paths", F.translate("consensus", "-", "").alias("fill"))
    return written(same.unionByName(merged), "fills"), va.variants(agreed.withColumnRenamed("consensus", "aln"), al, "gap_id")


def _contig_probes(scaffolds: DataFrame, reads: DataFrame, k: int, coverage_cutoff: float, overhang: int) -> tuple[DataFrame, AssemblyGraph, DataFrame]:
    """(contigs, graph, probes): the scaffolds' contigs, the graph of the reads with probes at both ends of contigs of two overhangs or more, and the
    probes (scaffold_idx, contig_idx, side, seq, probe_idx, node, offset, place, first, last) that are on a node, with whether their contig is a scaffold's first or last."""
    contigs = written(sc.break_scaffolds(scaffolds), "contigs")
    probes = written(sc.end_probes(sc.long_contigs(contigs, overhang), overhang), "contig-probes")
    g, found = probed_graph(reads, probes.select("probe_no", "seq"), k, coverage_cutoff)
    found = found.where("node_id is not null").select("probe_idx", "node_id", "fwd", oriented(F.col("node_id"), F.col("fwd")).alias("node"), F.coalesce("offset", F.lit(0)).alias("offset"), (F.coalesce("offset", F.lit(0)) - F.coalesce("start_coord", F.lit(0))).alias("place"))
    ends = contigs.select("scaffold_idx", "contig_idx", (F.col("contig_idx") == 0).alias("first"), (F.col("contig_idx") + 1 == F.col("contigs")).alias("last"))
    at = probes.withColumn("probe_idx", F.col("probe_no") - 1).drop("probe_no").join(found, "probe_idx").join(ends, ["scaffold_idx", "contig_idx"])
    return contigs, g, written(at, "probes-found")


def _inner_gaps(probes: DataFrame) -> DataFrame:
    """(gap_id, scaffold_idx, contig_idx, start, stop, left, right, left_at, right_at): gaps between consecutive contigs whose probes were found; contig_idx is that before the gap."""
    before = probes.where("side = 'end'").select("scaffold_idx", "contig_idx", F.col("node").alias("start"), F.col("seq").alias("left"), F.col("place").alias("left_at"))
    behind = probes.where("side = 'start'").select("scaffold_idx", (F.col("contig_idx") - 1).alias("contig_idx"), (-F.col("node")).alias("stop"), revcomp(F.col("seq")).alias("right"), F.col("place").alias("right_at"))
    ranked = global_rank(before.join(behind, ["scaffold_idx", "contig_idx"]), ["scaffold_idx", "contig_idx"], "inner-sorted")
    return ranked.withColumn("gap_id", 2 * F.col("rank")).drop("rank")  # gaps between scaffolds have odd ones


def _joined_parts(rows: DataFrame, whole: str, ord_: str, part: str) -> DataFrame:
    """(whole, seq): the parts in order as one text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(part).alias("p")))), lambda x: x["p"]), "")
    return rows.groupBy(whole).agg(text.alias("seq"))


def filled_scaffolds(contigs: DataFrame, inner: DataFrame, found: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaffold_idx, name, seq, filled), the variants in the scaffolds' coordinates (scaffold_idx, pos, type, seq, del_len, before: the base ahead of the fill, fill,
    at: where the fill begins) and the filled gaps (scaffold_idx, name, start, stop: first and last N); gaps without a fill keep their N."""
    gaps = sc.gaps(contigs).withColumn("contig_idx", F.col("gap_no")).join(inner.select("scaffold_idx", "contig_idx", "gap_id"), ["scaffold_idx", "contig_idx"], "left")
    gaps = written(gaps.join(found.select("gap_id", "fill"), "gap_id", "left"), "gaps-filled")
    parts = contigs.select("scaffold_idx", "name", F.col("start").alias("at"), F.col("seq").alias("part"), F.lit(None).cast("long").alias("gap_id"))
    part = F.coalesce("fill", F.expr("repeat('N', cast(stop - start + 1 as int))"))
    parts = parts.unionByName(gaps.select("scaffold_idx", "name", F.col("start").alias("at"), part.alias("part"), F.when(F.col("fill").isNotNull(), F.col("gap_id")).alias("gap_id")))
    counts = parts.groupBy("scaffold_idx", "name").agg(F.count("gap_id").cast("long").alias("filled"))
    out = _joined_parts(parts, "scaffold_idx", "at", "part").join(counts, "scaffold_idx").select("scaffold_idx", "name", "seq", "filled")
    order = Window.partitionBy("scaffold_idx").orderBy("at")
    places = parts.select("scaffold_idx", "gap_id", "at", F.length("part").alias("n"), F.expr("right(part, 1)").alias("tail"), F.when(F.col("gap_id").isNotNull(), F.col("part")).alias("fill"))
    places = places.withColumn("from", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("before", F.lag("tail").over(order)).where("gap_id is not null")
    v = variants.join(places.select("gap_id", "scaffold_idx", "from", "before", "fill"), "gap_id")
    v = v.select("scaffold_idx", (F.col("pos") + F.col("from")).alias("pos"), "type", "seq", "del_len", "before", "fill", F.col("from").alias("at"))
    return out, v, gaps.where("fill is not null").select("scaffold_idx", "name", "start", "stop")


def _vcf(v: DataFrame, name: str) -> DataFrame:
    """VCF rows of variants whose fill, with the base ahead of it, is their reference: no long sequence is cut for a row."""
    near = v.withColumn("_ref", F.concat("before", "fill")).withColumn("pos", F.col("pos") - F.col("at") + 1).withColumn("_name", F.struct(F.col(name).alias("n"), F.col("at")))
    rows = va.vcf_rows(near, "_name", "_ref")
    return rows.withColumn("POS", (F.col("POS") + F.col("CHROM.at") - 1).cast("long")).withColumn("CHROM", F.col("CHROM.n"))


def gapfill_all(scaffolds: DataFrame, reads: DataFrame, k: int = 51, coverage_cutoff: float = 3.5, overhang: int = 200, leash: int = 20_000, max_paths: int = 10, max_coverage: bool = False, **options) -> dict[str, DataFrame]:
    """scaffolds (scaffold_idx, name, seq, filled), their variants as VCF rows, and filled gaps (scaffold_idx, name, start, stop)."""
    contigs, g, probes = _contig_probes(scaffolds, reads, k, coverage_cutoff, overhang)
    inner = written(_inner_gaps(probes), "inner-gaps")
    found, variants = fills(g, inner, leash, max_paths, max_coverage, **options)
    out, v, gaps = filled_scaffolds(contigs, inner, found, variants)
    names = scaffolds.select("scaffold_idx", "name")
    return {"scaffolds": out, "variants": _vcf(v.join(names, "scaffold_idx"), "name"), "filled": gaps}


def gapfill(scaffolds: DataFrame, reads: DataFrame, **options) -> DataFrame:
    """(scaffold_idx, name, seq, filled): gaps replaced by what the paths between their probes agree on; the others keep their N."""
    return gapfill_all(scaffolds, reads, **options)["scaffolds"]


def roundup(
    scaffolds: DataFrame, reads: DataFrame, k: int = 51, coverage_cutoff: float = 3.5, overhang: int = 200, leash: int = 20_000, gapfill_only: bool = False, unknown_gap: int = 100,
    max_paths: int = 10, max_coverage: bool = False, recoherence: int | None = None,
) -> dict[str, DataFrame]:
    """Scaffolds (genome, scaffold_idx, name, seq), ids distinct over all genomes, joined by what their ends connect to within a genome, with gaps filled inside them and
    between them, over one graph of all:

    scaffolds (genome, name, header, seq, circular), connections (seq1, side1, seq2, side2, distance), variants (VCF rows by new scaffold), filled (scaffold_idx, name, start,
    stop) and report (genome, scaffolds, joined, filled_inside, filled_between, unconnected_ends). A join that no path fills gets ``unknown_gap`` N."""
    none = F.lit(None).cast("long")
    scaffolds = written(scaffolds.select("genome", F.col("scaffold_idx").cast("long").alias("scaffold_idx"), "name", "seq"), "roundup-scaffolds")
    contigs, g, probes = _contig_probes(scaffolds, reads, k, coverage_cutoff, overhang)
    genome = scaffolds.select("scaffold_idx", "genome")
    tips = probes.where("(side = 'start' and first) or (side = 'end' and last)")
    if gapfill_only:
        c = scaffolds.sparkSession.createDataFrame([], "seq1 long, side1 string, seq2 long, side2 string, distance long")
    else:
        c = connections_between(g, tips, leash, recoherence).select("seq1", "side1", "seq2", "side2", "distance")
        own = [genome.select(F.col("scaffold_idx").alias(f"seq{n}"), F.col("genome").alias(f"g{n}")) for n in (1, 2)]
        c = sc.canonical_connections(c.join(own[0], "seq1").join(own[1], "seq2").where("g1 <=> g2")).distinct()
    c = written(c, "roundup-connections")
    ids = scaffolds.select(F.col("scaffold_idx").alias("seq"))
    members = written(sc.chains(ids, c), "roundup-members")

    order = Window.partitionBy("scaffold").orderBy("ord")
    outward = lambda fwd: F.when(fwd, "end").otherwise("start")
    joins = members.withColumn("next", F.lead("seq").over(order)).withColumn("next_fwd", F.lead("fwd").over(order)).where("next is not null")
    joins = joins.select("scaffold", "ord", F.col("seq").alias("seq1"), outward(F.col("fwd")).alias("side1"), F.col("next").alias("seq2"), outward(~F.col("next_fwd")).alias("side2"))
    tip = lambda n: tips.select(F.col("scaffold_idx").alias(f"seq{n}"), F.col("side").alias(f"side{n}"), F.col("node").alias(f"node{n}"), F.col("seq").alias(f"probe{n}"), F.col("place").alias(f"place{n}"))
    between = joins.join(tip(1), ["seq1", "side1"]).join(tip(2), ["seq2", "side2"]).select(
        "scaffold", "ord", F.col("node1").alias("start"), (-F.col("node2")).alias("stop"), F.col("probe1").alias("left"), revcomp(F.col("probe2")).alias("right"),
        F.col("place1").alias("left_at"), F.col("place2").alias("right_at"),
    )
    between = global_rank(between, ["scaffold", "ord"], "between-sorted").withColumn("gap_id", 2 * F.col("rank") + 1).drop("rank")
    between, inner = written(between, "roundup-between"), written(_inner_gaps(probes), "roundup-inner")
    wanted = ["gap_id", "start", "stop", "left", "right", "left_at", "right_at"]
    found, variants = fills(g, inner.select(*wanted).unionByName(between.select(*wanted)), leash, max_paths, max_coverage, recoherence=recoherence)
    inside, v_inside, gaps = filled_scaffolds(contigs, inner, found, variants)
    inside, gaps = written(inside, "roundup-inside"), written(gaps, "roundup-filled")

    # members in order, each with what follows it: the fill of the join, or N
    last = F.max("ord").over(Window.partitionBy("scaffold"))
    rows = members.withColumn("last", F.col("ord") == last).join(inside.select(F.col("scaffold_idx").alias("seq"), F.col("seq").alias("s"), "name"), "seq")
    rows = rows.join(between.select("scaffold", "ord", "gap_id").join(found.select("gap_id", "fill"), "gap_id"), ["scaffold", "ord"], "left")
    follows = F.when(F.col("last"), "").otherwise(F.coalesce("fill", F.repeat(F.lit("N"), F.lit(unknown_gap))))
    rows = rows.select(
        "scaffold", "ord", "seq", "fwd", "circular", "name", "gap_id", F.col("fill").alias("filled"), F.when(F.col("fwd"), F.col("s")).otherwise(revcomp(F.col("s"))).alias("s"), follows.alias("follows")
    )
    rows = rows.withColumn("n", F.length("s")).withColumn("from", F.coalesce(F.sum(F.col("n") + F.length("follows")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = written(rows, "roundup-rows")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ":")
    heads = rows.groupBy("scaffold").agg(F.first("circular").alias("circular"), names.alias("names"), F.min(F.when(F.col("ord") == 0, F.col("seq"))).alias("lead"))
    heads = heads.join(genome.withColumnRenamed("scaffold_idx", "lead"), "lead")
    heads = global_rank(heads.select("genome", "scaffold", "circular", "names"), ["genome", "scaffold"], "roundup-heads")
    first = heads.groupBy(F.col("genome").alias("_g")).agg(F.min("rank").alias("first"))
    heads = heads.join(F.broadcast(first), F.col("genome").eqNullSafe(F.col("_g"))).drop("_g")  # a row for each genome
    heads = written(heads.withColumn("title", F.concat(F.lit("scaffold"), (F.col("rank") - F.col("first") + 1).cast("string"))), "roundup-titles")
    text = _joined_parts(rows.withColumn("part", F.concat("s", "follows")), "scaffold", "ord", "part")
    out = heads.join(text, "scaffold").select(
        "genome", F.col("title").alias("name"), F.concat("title", F.when(F.col("circular"), " circular ").otherwise(" scaffold "), "names").alias("header"), "seq", "circular"
    )

    # variants: those inside turn with their scaffold and move with its place; those of joins stand behind the member before
    place = rows.select(F.col("seq").alias("scaffold_idx"), "scaffold", "fwd", "n", "from")
    turned = F.expr("case when type = 'DELETION' then del_len when type = 'SWAP' then length(seq) else 0 end")
    v1 = v_inside.join(place, "scaffold_idx")
    v1 = v1.select(
        "scaffold", (F.when(F.col("fwd"), F.col("pos")).otherwise(F.col("n") - F.col("pos") - turned) + F.col("from")).alias("pos"), "type",
        F.when(F.col("fwd"), F.col("seq")).otherwise(revcomp(F.col("seq"))).alias("seq"), "del_len",
    )
    ends = rows.where("filled is not null").select("gap_id", "scaffold", (F.col("from") + F.col("n")).alias("at"))
    v2 = variants.join(ends, "gap_id").select("scaffold", (F.col("pos") + F.col("at")).alias("pos"), "type", "seq", "del_len")
    v = v1.unionByName(v2).join(heads.select("scaffold", "title", "genome"), "scaffold").join(text.withColumnRenamed("seq", "_text"), "scaffold")
    # a short piece of the new scaffold around each variant is its reference
    v = v.withColumn("at", F.greatest(F.col("pos") - 1, F.lit(0))).withColumn("_piece", F.expr("substr(_text, at + 1, 2 + coalesce(length(seq), 0) + coalesce(del_len, 0))"))
    v = v.withColumn("pos", F.col("pos") - F.col("at")).withColumn("_name", F.struct("title", "at", "genome"))
    vcf = va.vcf_rows(v, "_name", "_piece")
    vcf = vcf.select(F.col("CHROM.genome").alias("genome"), F.col("CHROM.title").alias("CHROM"), (F.col("POS") + F.col("CHROM.at")).cast("long").alias("POS"), "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")

    count = lambda df, name: df.groupBy("genome").agg(F.count("*").alias(name))
    per = [
        count(scaffolds, "scaffolds"), count(heads, "joined"), count(gaps.join(genome, "scaffold_idx"), "filled_inside"),
        count(rows.where("filled is not null").join(heads.select("scaffold", "genome"), "scaffold"), "filled_between"),
        count(sc.unconnected_ends(ids, c).join(genome.withColumnRenamed("scaffold_idx", "seq"), "seq"), "unconnected_ends"),
    ]
    report = per[0]
    for p in per[1:]:
        report = report.join(p, "genome", "left")
    report = report.select("genome", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("scaffolds", "joined", "filled_inside", "filled_between", "unconnected_ends")])
    return {"scaffolds": out, "connections": c, "variants": vcf, "filled": gaps, "report": report}


def explore_ends(scaffolds: DataFrame, reads: DataFrame, ends: DataFrame | None = None, k: int = 51, coverage_cutoff: float = 3.5, overhang: int = 200, leash: int = 20_000) -> DataFrame:
    """(name, side, path, fate, seq): all acyclic paths beyond contig ends; ``ends`` (name, side) restricts them."""
    if overhang < k:
        raise ValueError("the overhang must not be shorter than k")
    rows = scaffolds.select("scaffold_idx", "name", F.lit(0).alias("contig_idx"), "seq")
    probes = sc.end_probes(rows, overhang).join(scaffolds.select("scaffold_idx", "name"), "scaffold_idx")
    if ends is not None:
        probes = probes.join(ends, ["name", "side"], "left_semi")
    g, found = probed_graph(reads, probes, k, coverage_cutoff)
    starts = gr.initial_paths(found).withColumnRenamed("probe_idx", "source")
    paths = written(global_rank(tv.explore(g.edges(), g.nodes, starts, k, leash), ["source", "path"], "explored-sorted", "path_id"), "explored")
    seqs = gr.trail_sequences(paths, g.nodes, k)
    named = probes.select((F.col("probe_no") - 1).alias("source"), "name", "side")
    return paths.join(seqs, "path_id").join(named, "source").select("name", "side", "path", "fate", "seq")


def fluff(seqs: DataFrame, reads: DataFrame, k: int = 51, coverage_cutoff: float = 3.5, spacing: int = 2000, size: int = 100, leash: int = 20_000) -> DataFrame:
    """(probe_idx, path, fate): all acyclic paths from probes placed every ``spacing`` bases."""
    if size <= k:
        raise ValueError("probes must be longer than k")
    probes = global_rank(sc.tiled_probes(seqs, spacing, size), ["scaffold_idx", "offset"], "tiled-probes").withColumn("probe_no", F.col("rank") + 1).drop("rank")
    g, found = probed_graph(reads, probes, k, coverage_cutoff)
    at = gr.initial_paths(found).select("probe_idx", F.col("start").alias("node"), F.lit(0).alias("offset"))

    def walk(lg: wk.LocalGraph) -> Iterable[tuple]:
        mine = sorted(lg.probes)
        asked = set(lg.asked())
        return ((p, path, fate) for p, found in zip(mine, wk.fluff(lg, [lg.probes[p][0] for p in mine], leash)) if p in asked for path, fate in found)

    return wk.per_component(g, walk, "probe_idx long, path array<int>, fate string", probes=at, leash=leash)


def assemble(g: AssemblyGraph, opts: wk.AssembleOptions = wk.AssembleOptions(), bubbly: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """(name, path, shorthand, nested, fate, coverage, seq): contigs of a graph, or from ``starts`` (start_id, node) alone."""
    paths = written(global_rank(wk.assembled(g, opts, bubbly, starts), ["path"], "assembled-sorted", "path_id"), "assembled")
    seqs = gr.trail_sequences(paths, g.nodes, g.k)
    return paths.join(seqs, "path_id").select(F.concat(F.lit("contig_"), F.abs(F.col("path")[0]).cast("string")).alias("name"), "path", "shorthand", "nested", "fate", "coverage", "seq")


def chosen_ends(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, side) of ends written as a scaffold's name and 's' or 'e', or as a name alone for both; texts (column text) that fit no scaffold (column name) raise."""
    side = F.when(F.col("text") == F.col("name"), F.array(F.lit("start"), F.lit("end"))).when(F.col("text") == F.concat("name", F.lit("s")), F.array(F.lit("start")))
    side = side.when(F.col("text") == F.concat("name", F.lit("e")), F.array(F.lit("end")))
    keys = names.select("name", F.explode(F.array("name", F.concat("name", F.lit("s")), F.concat("name", F.lit("e")))).alias("text"))
    rows = texts.select("text").distinct().join(keys, "text", "left")
    unknown = F.raise_error(F.concat(F.lit("no scaffold end is named "), F.col("text"))).cast("string")
    rows = rows.select(F.when(F.col("name").isNull(), unknown).otherwise(F.col("name")).alias("name"), F.explode_outer(side).alias("side"))
    return rows.distinct()


def sequence(g: AssemblyGraph, paths: DataFrame) -> DataFrame:
    """(path_id, seq) of explicit paths (path_id, path); a step that no arc allows raises."""
    broken = gr.broken_steps(paths, g.edges()).limit(1).collect()
    if broken:
        raise ValueError(f"path {broken[0]['path_id']} has a step that no arc allows")
    return gr.trail_sequences(paths, g.nodes, g.k)


def count_paths(g: AssemblyGraph, starts: DataFrame | None = None) -> DataFrame:
    """(min_paths, max_paths) through the graph from starts (column node), or from where the graph begins; cycles are cut open."""
    edges = g.edges()
    found = cy.levels(edges, tv.leash_starts(edges, g.nodes) if starts is None else starts)
    return found.min_paths().crossJoin(F.broadcast(found.max_paths()))  # one row each


def find_orfs(g: AssemblyGraph, starts: DataFrame, leash: int = 20_000, min_length: int = 96, max_cycles: int = 1, max_paths: int | None = 2196) -> DataFrame:
    """(name, orf, protein): reading frames over all walks from starts (source, start) that go round no cycle more than ``max_cycles`` times; a start with more than
    ``max_paths`` walks gives none."""
    probes = starts.select(F.monotonically_increasing_id().alias("probe_idx"), F.col("start").alias("node"), F.lit(0).alias("offset"))

    def walk(lg: wk.LocalGraph) -> Iterable[tuple]:
        return ((p, path) for p in lg.asked() for path in wk.walks(lg, lg.probes[p][0], leash, max_cycles, max_paths).paths)

    paths = written(wk.per_component(g, walk, "source long, path array<int>", probes=written(probes, "orf-starts"), leash=leash), "orf-walks")
    paths = written(global_rank(paths, ["source", "path"], "orf-sorted", "path_id"), "orf-paths")
    long = gr.trail_coverage(paths, g.nodes).where(F.col("bp") >= g.k - 1).select("path_id")
    seqs = gr.trail_sequences(paths.join(long, "path_id", "left_semi"), g.nodes, g.k)
    found = of.proteins(of.orf_sequences(seqs, min_length, "path_id"))
    distinct = found.select("orf", "protein").distinct()
    return global_rank(distinct, ["orf"], "orfs").select(F.concat(F.lit("orf_"), (F.col("rank") + 1).cast("string")).alias("name"), "orf", "protein")


def write_orfs(orfs: DataFrame, folder: str) -> None:
    """``orfs.fna`` and ``orfs.faa`` under the folder: the frames and their proteins as FASTA."""
    from strandflow.sources.sinks import write_fasta

    for kind, column in (("fna", "orf"), ("faa", "protein")):
        write_fasta(orfs.select("name", F.col(column).alias("seq")), f"{folder}/orfs.{kind}", ["name"])


def visualise(g: AssemblyGraph, starts: DataFrame, leash: int = 20_000, far_edges: DataFrame | None = None) -> DataFrame:
    """(ord, value): a Graphviz drawing of what is within the leash of starts (source, start)."""
    from strandflow.sources.sinks import dot_lines

    near = tv.nodes_within_leash(g.edges(), g.nodes, starts, leash, far_edges)
    kept = gr.keep_nodes(g, near)
    return dot_lines(kept, starts=starts.select(F.abs("start").alias("node_id")), paired=far_edges)
