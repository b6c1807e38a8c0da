import json

import pytest
from pyspark.sql import functions as F

from helpers import graph
from strandflow.functions import trails as tr
from strandflow.operators import graph as gr
from strandflow.operators import scaffolds as sc
from strandflow.operators import walkers as wk
from strandflow.plans import pipelines as pl
from strandflow.sources import sequences as sf
from strandflow.sources import sinks


def test_removed_by_coverage(spark):
    g = graph(spark, "12 23 34", cov_sums={1: 5, 2: 50, 3: 60, 4: 5}, noded_reads=[(4, 9, True)])
    nodes, arcs = gr.removed_by_coverage(g, 3.5)
    assert sorted(r.node_id for r in nodes.collect()) == [1, 4] and sorted((r.begin_id, r.end_id) for r in arcs.collect()) == [(1, 2), (3, 4)]
    nodes, arcs = gr.removed_by_coverage(g, 3.5, spark.createDataFrame([(9,)], "read_id int"))
    assert [r.node_id for r in nodes.collect()] == [1] and [(r.begin_id, r.end_id) for r in arcs.collect()] == [(1, 2)]


def test_adjusted_position(spark):
    rows = spark.createDataFrame([(3, 10, True), (3, 10, False)], "o int, n int, fwd boolean")
    assert [r[0] for r in rows.select(gr.adjusted_position(F.col("o"), F.col("n"), F.col("fwd"))).collect()] == [3, 7]


def test_nodes_by_kmers(spark):
    nodes = spark.createDataFrame([(1, "ACGTT", "AACGT"), (2, "ACGGG", "CCCGT"), (3, "TTTTT", "AAAAA")], "node_id int, ends_fwd string, ends_twin string")
    kmers = lambda *k: spark.createDataFrame(list(enumerate(k)), "ord int, kmer string")
    ids = lambda *k: sorted(r.node_id for r in gr.nodes_by_kmers(nodes, kmers(*k)).collect())
    assert ids("ACG", "GGG", "TTTT") == [2] and ids("CGT", "ACG") == [1, 2] and ids("GAT") == [] and ids("AAAA", "ACG") == [3]
    one = gr.unique_node_by_kmers(nodes, kmers("ACG", "GGG")).first()
    assert (one.ord, one.node_id, one.fwd) == (1, 2, True)


def test_names_leashes_and_subsets(spark):
    reads = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, read_id int")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(map(tuple, gr.reads_by_name(reads, names).collect())) == [("a", 1), ("a", 2), ("b", 3)]
    with pytest.raises(Exception, match="not one or two"):
        gr.reads_by_name(reads, spark.createDataFrame([("z",)], "name string")).collect()
    found = spark.createDataFrame([(0, 5, 10), (1, 6, 0), (2, 7, 3)], "probe_idx int, node_id int, offset int")
    assert [r.leash for r in gr.adjusted_leash(found, 100).sort("probe_idx").collect()] == [110, 100, 103]
    assert sorted((r.probe_idx, r.node_id) for r in gr.probe_subset(found, [3, 1]).collect()) == [(0, 7), (1, 5)]


def test_trail_columns(spark):
    df = spark.createDataFrame([([1, -2, 3],), ([4],)], "path array<int>")
    assert [r[0] for r in df.select(tr.last(F.col("path"))).collect()] == [3, 4]
    assert [r[0] for r in df.select(tr.contains(F.col("path"), F.lit(-2))).collect()] == [True, False]
    assert [[tuple(x) for x in r[0]] for r in df.select(tr.steps(F.col("path"))).collect()] == [[(1, -2), (-2, 3)], []]


def test_gap_lengths_and_end_names(spark):
    s = spark.createDataFrame([(0, "x", "AAAAANNNCCCCCNTTTTT")], "scaffold_idx int, name string, seq string")
    c = sc.break_scaffolds(s)
    assert [(r.gap_no, r.length) for r in sc.gap_lengths(c).sort("gap_no").collect()] == [(0, 3), (1, 1)]
    assert [r.end_name for r in sc.end_names(sc.end_probes(c, 2), s).sort("probe_no").collect()][:3] == ["x 1 start", "x 1 end", "x 2 start"]


def test_circular_singles_and_headers(spark):
    c = sc.canonical_connections(spark.createDataFrame([(1, "end", 1, "start", 5), (2, "end", 3, "start", 1)], "seq1 int, side1 string, seq2 int, side2 string, distance int"))
    assert [r.seq for r in sc.circular_singles(c).collect()] == [1]
    rows = sc.scaffold_headers(spark.createDataFrame([(5, False), (2, True)], "scaffold int, circular boolean"))
    assert sorted((r.scaffold, r.header) for r in rows.collect()) == [(2, "circular1"), (5, "scaffold2")]


def test_contigs_from_one_start_and_nested_text(spark):
    g = graph(spark, "12 13 24 34 45", lengths={n: 60 for n in range(1, 6)})
    starts = spark.createDataFrame([(0, 1)], "start_id int, node int")
    opts = wk.AssembleOptions(max_tip_length=5, min_contig_size=0)
    r = pl.assemble(g, opts, bubbly=True, starts=starts).collect()
    assert [x.shorthand for x in r] == ["1s,{1s>2s|1s>3s|2s>4s|3s>4s},4s,5s"]
    line = json.loads(sinks.nested_lines(pl.assemble(g, opts, bubbly=True, starts=starts)).first().value)
    assert line["contig_name"] == "contig_1" and [x["type"] for x in line["graph"]] == ["regular", "bubble", "regular", "regular"]
    assert [x["node"] for x in line["graph"][1]["nodes"]] == ["2s", "3s"] and line["graph"][1]["steps"] == [["1s", "2s"], ["1s", "3s"], ["2s", "4s"], ["3s", "4s"]] and line["graph"][0] == {"type": "regular", "node": "1s", "coverage": 5 / 60}
    assert [x.shorthand for x in pl.assemble(g, opts, starts=starts).collect()] == ["1s"]


def test_chosen_ends(spark):
    names = spark.createDataFrame([("contig1",), ("tests",)], "name string")
    ends = lambda *t: sorted(map(tuple, pl.chosen_ends(names, spark.createDataFrame([(x,) for x in t], "text string")).collect()))
    assert ends("contig1s") == [("contig1", "start")] and ends("tests", "contig1e") == [("contig1", "end"), ("tests", "end"), ("tests", "start")]
    with pytest.raises(Exception, match="no scaffold end"):
        ends("contig9s")


def test_output_folder(spark, tmp_path):
    made = sinks.output_folder(spark, str(tmp_path / "new"))
    assert (tmp_path / "new").is_dir() and sinks.output_folder(spark, made) == made
    (tmp_path / "new" / "x").write_text("1")
    with pytest.raises(FileExistsError):
        sinks.output_folder(spark, made)
    with pytest.raises(NotADirectoryError):
        sinks.output_folder(spark, str(tmp_path / "new" / "x"))


def test_lines_and_vcf(spark, tmp_path):
    c = spark.createDataFrame([("a", "end", "b", "start", 5)], "name1 string, side1 string, name2 string, side2 string, distance int")
    assert sinks.connection_lines(c).first().value == "a:end\tb:start\t5"
    contigs = spark.createDataFrame([("a", "ACGT", 2.5)], "name string, seq string, coverage double")
    assert tuple(sinks.contig_stats(contigs).first()) == ("a", 4, 2.5)
    rows = spark.createDataFrame([("x", 7, "."), ("x", 3, ".")], "CHROM string, POS int, ID string")
    sinks.write_vcf(rows, str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert sorted(lines) == ["#CHROM\tPOS\tID", "x\t3\t.", "x\t7\t."]


def test_cutoff_after_the_assembly_keeps_probes(spark):
    import random

    rng = random.Random(11)
    s, u = ("".join(rng.choices("ACGT", k=200)) for _ in range(2))
    reads = spark.createDataFrame([(i, s) for i in range(9)] + [(20, u)], "read_id long, seq string")
    probes = spark.createDataFrame([(1, u[:60])], "probe_no int, seq string")
    all_, _ = pl.probed_graph(reads, probes, 21, 0)
    kept, found = pl.probed_graph(reads, probes, 21, 0, post_assembly_coverage_cutoff=4.0)
    assert all_.nodes.count() == 2 and kept.nodes.count() == 2 and found.first().node_id is not None
    other = spark.createDataFrame([(1, s[:60])], "probe_no int, seq string")
    assert pl.probed_graph(reads, other, 21, 0, post_assembly_coverage_cutoff=4.0)[0].nodes.count() == 1
    assert sf.ReadInput().validate()


def test_frames_on_walks_round_a_loop(spark, tmp_path):
    """A frame that goes round a loop once and on is found, by brute force over the texts of the walks."""
    import random

    rng = random.Random(12)
    a, loop, b = ("".join(rng.choices("ACGT", k=n)) for n in (60, 45, 60))
    text = "ATG" + a.replace("T", "C") + loop.replace("T", "C") * 2 + b.replace("T", "C")
    text = text[: len(text) // 3 * 3] + "TAA" + "C" * 40
    reads = spark.createDataFrame([(0, text)], "read_id long, seq string")
    probes = spark.createDataFrame([(1, text[:50])], "probe_no int, seq string")
    g, found = pl.probed_graph(reads, probes, 21, 0)
    starts = gr.initial_paths(found).select(F.col("probe_idx").alias("source"), "start")
    orfs = pl.find_orfs(g, starts, 10_000, 30)
    got = {r.orf for r in orfs.collect()}
    assert text[: text.index("TAA") + 3] in got  # through the loop, twice its text
    pl.write_orfs(orfs, str(tmp_path))
    assert {r.seq for r in sf.read_fasta(spark, str(tmp_path / "orfs.fna")).collect()} == got
