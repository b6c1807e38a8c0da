"""Scaffolds broken into contigs and gaps, probes at their ends, and scaffolds built anew from connections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.sequence import revcomp
from strandflow.lineage import global_rank, written
from strandflow.ranking import list_ranks

_ACGT = np.array([ord(x) for x in "ACGT"], np.uint32)


def _runs(most: int = 1 << 14, bases: int = 1 << 22):
    """A row for each run of A, C, G and T of each scaffold, so many rows and bases at a time: a batch of scaffolds may hold very many runs."""

    def run(batches):
        for batch in batches:
            idx, name, texts = batch.columns
            at, number, starts, stops, parts, size, total = held = [], [], [], [], [], [], []

            def out():
                where = pa.array(at, pa.int64())
                columns = [idx.take(where), name.take(where), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, stops)), pa.array(parts, pa.string()), pa.array(size, pa.int32()), pa.array(total, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["scaffold_idx", "name", "contig_idx", "start", "stop", "seq", "scaffold_length", "contigs"])

            held_bases = 0
            for row in range(batch.num_rows):
                text = (texts[row].as_py() or "").upper()
                edges = np.diff(np.isin(np.frombuffer(text.encode("utf-32-le"), np.uint32), _ACGT).astype(np.int8), prepend=0, append=0)
                first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                if not len(first):
                    raise ValueError(f"no bases in scaffold {name[row].as_py()}")
                for lo in range(0, len(first), most):
                    x, y = first[lo : lo + most].tolist(), last[lo : lo + most].tolist()
                    at += [row] * len(x)
                    number += range(lo, lo + len(x))
                    starts += [i + 1 for i in x]
                    stops += y
                    parts += [text[i:j] for i, j in zip(x, y)]
                    size += [len(text)] * len(x)
                    total += [len(first)] * len(x)
                    held_bases += y[-1] - x[0]
                    if len(at) >= most or held_bases >= bases:
                        yield out()
                        held_bases = 0
                        for column in held:
                            column.clear()
            if at:
                yield out()

    return run


def break_scaffolds(scaffolds: DataFrame, idx: str = "scaffold_idx", name: str = "name", seq: str = "seq") -> DataFrame:
    """(scaffold_idx, name, contig_idx, start, stop, seq, scaffold_length, contigs): maximal runs without N, 1-based and inclusive. Other
    characters than ACGTN count as N; a scaffold of nothing else raises. Each scaffold is read once, without a shuffle."""
    rows = scaffolds.select(F.col(idx).alias("scaffold_idx"), F.col(name).alias("name"), seq)
    kind = rows.schema["scaffold_idx"].dataType.simpleString()
    return rows.mapInArrow(_runs(), f"scaffold_idx {kind}, name string, contig_idx int, start long, stop long, seq string, scaffold_length int, contigs long")


def gaps(contigs: DataFrame) -> DataFrame:
    """(scaffold_idx, name, gap_no, start, stop, coords): between consecutive contigs; coords are those of the first and last N."""
    order = Window.partitionBy("scaffold_idx").orderBy("start")
    rows = contigs.withColumn("_before", F.lag("stop").over(order)).where("_before is not null")
    rows = rows.select("scaffold_idx", "name", (F.row_number().over(order) - 1).alias("gap_no"), (F.col("_before") + 1).alias("start"), (F.col("start") - 1).alias("stop"))
    return rows.withColumn("coords", F.concat(F.col("name"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")))


def rebuilt(contigs: DataFrame) -> DataFrame:
    """(scaffold_idx, seq): contigs joined by as many N as stood between them, from the first contig to the last."""
    order = Window.partitionBy("scaffold_idx").orderBy("start")
    part = F.concat(F.repeat(F.lit("N"), F.col("start") - F.coalesce(F.lag("stop").over(order), F.col("start") - 1) - 1), F.col("seq"))
    rows = contigs.select("scaffold_idx", "start", part.alias("part"))
    return rows.groupBy("scaffold_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("seq"))


def contig_names(contigs: DataFrame) -> DataFrame:
    """``contig_name``: {scaffold}_{i}of{n}_{start}to{stop}."""
    return contigs.withColumn(
        "contig_name", F.format_string("%s_%dof%d_%dto%d", "name", F.col("contig_idx") + 1, F.col("contigs"), F.col("start"), F.col("stop"))
    )


def long_contigs(contigs: DataFrame, overhang: int) -> DataFrame:
    """Contigs of at least twice the overhang; scaffolds without any are gone."""
    return contigs.where(F.length("seq") >= 2 * overhang)


def end_probes(contigs: DataFrame, overhang: int) -> DataFrame:
    """(probe_no, scaffold_idx, contig_idx, side, seq): two for each contig, numbered from 1 in order; the start's points outward
    (reverse complement of the first bases), the end's is the last bases."""
    first = F.struct(F.lit("start").alias("side"), revcomp(F.substring("seq", 1, overhang)).alias("seq"))
    last = F.struct(F.lit("end").alias("side"), F.expr(f"right(seq, {overhang})").alias("seq"))
    rows = contigs.select("scaffold_idx", "contig_idx", F.posexplode(F.array(first, last)).alias("_k", "p"))
    rows = global_rank(rows, ["scaffold_idx", "contig_idx", "_k"], "end-probes")
    return rows.select((F.col("rank") + 1).cast("int").alias("probe_no"), "scaffold_idx", "contig_idx", "p.side", "p.seq")


def tiled_probes(seqs: DataFrame, spacing: int = 2000, size: int = 100, idx: str = "scaffold_idx", seq: str = "seq") -> DataFrame:
    """(scaffold_idx, offset, seq): every ``spacing`` bases from 0 while one more base follows the probe."""
    last = F.length(seq) - 1 - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(spacing))).otherwise(F.array().cast("array<int>"))
    return seqs.withColumn("offset", F.explode(at)).select(F.col(idx).alias("scaffold_idx"), "offset", F.expr(f"substr({seq}, offset + 1, {size})").alias("seq"))


def gap_probes(scaffolds: DataFrame, overhang: int, idx: str = "scaffold_idx", name: str = "name", seq: str = "seq") -> DataFrame:
    """(scaffold_idx, gap_no, left, right): the overhang before each gap and the reverse complement of what follows it (one base longer);
    gaps whose probes would leave the scaffold or hold an N are skipped."""
    order = Window.partitionBy("scaffold_idx").orderBy("start")
    ends = break_scaffolds(scaffolds, idx, name, seq).select("scaffold_idx", "start", F.expr(f"right(seq, {overhang})").alias("tail"), F.expr(f"left(seq, {overhang + 1})").alias("head"))
    rows = ends.select("scaffold_idx", (F.row_number().over(order) - 2).alias("gap_no"), F.lag("tail").over(order).alias("left"), revcomp(F.col("head")).alias("right"))
    return rows.where((F.length("left") == overhang) & (F.length("right") == overhang + 1))  # a shorter contig leaves N or the scaffold's end within reach


def canonical_connections(connections: DataFrame) -> DataFrame:
    """(seq1, side1, seq2, side2, distance) with the smaller end first ('end' before 'start')."""
    a, b = F.struct(F.col("seq1").alias("seq"), F.col("side1").alias("side")), F.struct(F.col("seq2").alias("seq"), F.col("side2").alias("side"))
    return connections.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "distance").select(
        F.col("a.seq").alias("seq1"), F.col("a.side").alias("side1"), F.col("b.seq").alias("seq2"), F.col("b.side").alias("side2"), "distance"
    )


def checked_connections(connections: DataFrame) -> DataFrame:
    """Canonical connections; one given twice raises."""
    c = canonical_connections(connections)
    same = Window.partitionBy("seq1", "side1", "seq2", "side2")
    twice = F.when(F.count("*").over(same) > 1, F.raise_error(F.lit("a connection was given twice")).cast("int")).otherwise(F.col("distance"))
    return c.withColumn("distance", twice)


def connection_text(c: DataFrame) -> DataFrame:
    """``text``: '1e/2s:10'."""
    side = lambda s: F.substring(s, 1, 1)
    return c.withColumn("text", F.format_string("%d%s/%d%s:%d", "seq1", side("side1"), "seq2", side("side2"), "distance"))


def _ends(c: DataFrame) -> DataFrame:
    return c.select(F.col("seq1").alias("seq"), F.col("side1").alias("side")).unionByName(c.select(F.col("seq2").alias("seq"), F.col("side2").alias("side")))


def doubly_single(c: DataFrame) -> DataFrame:
    """Connections both of whose ends have no other connection."""
    degree = _ends(c).groupBy("seq", "side").agg(F.count("*").alias("degree")).where("degree = 1").select("seq", "side")
    one, two = degree.select(F.col("seq").alias("seq1"), F.col("side").alias("side1")), degree.select(F.col("seq").alias("seq2"), F.col("side").alias("side2"))
    return c.join(one, ["seq1", "side1"], "left_semi").join(two, ["seq2", "side2"], "left_semi")


def circular_singles(c: DataFrame) -> DataFrame:
    """Sequences whose own end leads to their own start and nowhere else."""
    return doubly_single(c).where("seq1 = seq2 and side1 != side2").select(F.col("seq1").alias("seq"))


def unconnected_ends(sequences: DataFrame, c: DataFrame) -> DataFrame:
    """(seq, side) of sequence ends without a connection."""
    every = sequences.select("seq", F.explode(F.array(F.lit("end"), F.lit("start"))).alias("side"))
    return every.join(_ends(c), ["seq", "side"], "left_anti")


def unconnected_sequences(sequences: DataFrame, c: DataFrame) -> DataFrame:
    return sequences.select("seq").join(_ends(c), "seq", "left_anti")


def probe_companion(seq: Column, side: Column) -> Column:
    """The other side of the same sequence: where a walk that came in by ``side`` goes out."""
    return F.struct(seq.alias("seq"), F.when(side == "start", "end").otherwise("start").alias("side"))


def chains(sequences: DataFrame, c: DataFrame) -> DataFrame:
    """(scaffold, ord, seq, fwd, gap_after, circular): sequences chained by doubly single connections, the rest alone.

    A scaffold reads from the tip whose sequence is smaller and is named by it; a ring starts at its smallest
    sequence, forwards, and its last gap closes it. Chains are ranked as lists of sequences read in either direction; of the two readings the one
    with the smaller head stays."""
    links = doubly_single(c)
    both = links.where("seq1 != seq2")
    read = lambda seq, fwd: 2 * F.col(seq).cast("long") + F.when(fwd, 0).otherwise(1)
    there = both.select(read("seq1", F.col("side1") == "end").alias("a"), read("seq2", F.col("side2") == "start").alias("b"), F.col("distance").cast("long").alias("gap_after"))
    back = both.select(read("seq2", F.col("side2") == "end").alias("a"), read("seq1", F.col("side1") == "start").alias("b"), F.col("distance").cast("long").alias("gap_after"))
    steps = written(there.unionByName(back), "chain-steps")
    ranked = written(list_ranks(steps, "chains").withColumn("seq", F.shiftright("node", 1)), "chain-ranks")
    least = ranked.groupBy("seq").agg(F.min("head").alias("head"))
    chained = ranked.join(least, ["seq", "head"]).join(steps.select(F.col("a").alias("node"), "gap_after"), "node", "left")
    chained = chained.select(F.shiftright("head", 1).alias("scaffold"), F.col("pos").cast("int").alias("ord"), "seq", (F.col("node") % 2 == 0).alias("fwd"), "gap_after", "circular")
    ring = links.where("seq1 = seq2 and side1 != side2").select(F.col("seq1").alias("seq"), F.col("distance").cast("long").alias("gap_after"))
    alone = sequences.select(F.col("seq").cast("long").alias("seq")).join(least.select("seq"), "seq", "left_anti").join(ring, "seq", "left")
    alone = alone.select(
        F.col("seq").alias("scaffold"), F.lit(0).alias("ord"), "seq", F.lit(True).alias("fwd"), "gap_after", F.col("gap_after").isNotNull().alias("circular")
    )
    return chained.unionByName(alone)


def scaffold_sequences(members: DataFrame, sequences: DataFrame, unknown_gap: int = 100) -> DataFrame:
    """(scaffold, circular, seq): contigs in order, turned where ``fwd`` is false, with N for the gaps between them."""
    part = F.when(F.col("fwd"), F.col("s")).otherwise(revcomp(F.col("s")))
    rows = members.join(sequences.select("seq", F.col("sequence").alias("s")), "seq")
    last = F.max("ord").over(Window.partitionBy("scaffold"))
    n = F.when(F.col("ord") < last, F.greatest(F.coalesce("gap_after", F.lit(unknown_gap)), F.lit(0))).otherwise(0).cast("int")
    rows = rows.select("scaffold", "circular", "ord", F.concat(part, F.repeat(F.lit("N"), n)).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "")
    return rows.groupBy("scaffold", "circular").agg(joined.alias("seq"))


def scaffold_headers(scaffolds: DataFrame) -> DataFrame:
    """``header``: 'scaffold1' or 'circular2', numbered in order from 1."""
    ranked = global_rank(scaffolds, ["scaffold"], "scaffold-headers", "_number")
    return ranked.withColumn("header", F.concat(F.when(F.col("circular"), "circular").otherwise("scaffold"), (F.col("_number") + 1).cast("string"))).drop("_number")


def probe_pairs(probes: DataFrame) -> DataFrame:
    """(scaffold_idx, gap_no, end_probe, start_probe): the probes on both sides of each gap."""
    order = Window.partitionBy("scaffold_idx").orderBy("probe_no")
    rows = probes.withColumn("start_probe", F.lead("probe_no").over(order)).where("side = 'end' and start_probe is not null")
    return rows.select("scaffold_idx", (F.row_number().over(order) - 1).alias("gap_no"), F.col("probe_no").alias("end_probe"), "start_probe")


def scaffold_end_probes(probes: DataFrame) -> DataFrame:
    """(scaffold_idx, first_probe, last_probe)."""
    return probes.groupBy("scaffold_idx").agg(F.min("probe_no").alias("first_probe"), F.max("probe_no").alias("last_probe"))


def gap_lengths(contigs: DataFrame) -> DataFrame:
    """(scaffold_idx, gap_no, length): how many N stand between consecutive contigs."""
    return gaps(contigs).select("scaffold_idx", "gap_no", (F.col("stop") - F.col("start") + 1).alias("length"))


def end_names(probes: DataFrame, names: DataFrame) -> DataFrame:
    """``end_name`` of probes (scaffold_idx, contig_idx, side): 'name 2 end', the scaffold's name, the contig's number from 1 and the side."""
    return probes.join(names.select("scaffold_idx", "name"), "scaffold_idx").withColumn("end_name", F.concat_ws(" ", "name", (F.col("contig_idx") + 1).cast("string"), "side"))
