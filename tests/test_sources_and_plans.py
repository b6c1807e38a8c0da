import random

import pytest
from pyspark.sql import functions as F

from helpers import graph
from strandflow.operators import walkers as wk
from strandflow.plans import pipelines as pl
from strandflow.sources import graph_text as gt
from strandflow.sources import sequences as sf
from strandflow.sources import sinks


def random_seq(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACG\nT\n>two\nGG\n")
    (tmp_path / "b.fq").write_text("@r1\nAC\n+\nII\n@r2\nGT\n+\nJJ\n")
    assert [(r.name, r.seq) for r in sf.read_fasta(spark, str(tmp_path / "a.fa")).sort("pos").collect()] == [("one x", "ACGT"), ("two", "GG")]
    r = sf.ReadInput(fasta_singles=[str(tmp_path / "a.fa")], interleaved_fastq=[str(tmp_path / "b.fq")]).reads(spark).sort("read_id").collect()
    assert [(x.read_id, x.seq, x.pair_id) for x in r] == [(1, "ACGT", None), (2, "GG", None), (3, "AC", 4), (4, "GT", 3)]
    assert sf.ReadInput().validate() and not sf.ReadInput().validate("kept")


def test_fasta_headers_with_signs_and_line_ends(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">s1 A->B variant\r\nAC\r\nGT\r\n>s2 >x\nGG\n>empty\n>last\nT")
    got = [(r.name, r.seq) for r in sf.read_fasta(spark, str(tmp_path / "a.fa")).sort("pos").collect()]
    assert got == [("s1 A->B variant", "ACGT"), ("s2 >x", "GG"), ("empty", ""), ("last", "T")]


def test_fasta_and_fastq_in_many_splits(spark, tmp_path):
    seqs = [random_seq(10 + i % 90, i) for i in range(400)]
    (tmp_path / "a.fa").write_text("".join(f">n{i} >{i}\n{s[:7]}\n{s[7:]}\n" for i, s in enumerate(seqs)))
    (tmp_path / "b.fq").write_text("".join(f"@n{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert [(r.name, r.seq) for r in sf.read_fasta(spark, str(tmp_path / "a.fa")).sort("pos").collect()] == [(f"n{i} >{i}", s) for i, s in enumerate(seqs)]
        assert [(r.name, r.seq, r.qual) for r in sf.read_fastq(spark, str(tmp_path / "b.fq")).sort("pos").collect()] == [(f"n{i}", s, "@" * len(s)) for i, s in enumerate(seqs)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_abundances(spark, tmp_path):
    (tmp_path / "k").write_text("AAA " + " ".join(map(str, range(10_050))) + "\n")
    assert sf.read_abundances(spark, str(tmp_path / "k")).first().counts == list(range(10_050))


def test_lists_and_abundances(spark, tmp_path):
    (tmp_path / "ids").write_text("3\n17\n")
    assert [r.value for r in sf.read_list(spark, str(tmp_path / "ids"), True).collect()] == [3, 17]
    (tmp_path / "bad").write_text("3x\n")
    with pytest.raises(Exception, match="not a number"):
        sf.read_list(spark, str(tmp_path / "bad"), True).collect()
    (tmp_path / "k").write_text("aaa 1 2\nAAC 0 5\n")
    assert sorted(map(tuple, sf.read_abundances(spark, str(tmp_path / "k")).collect())) == [("AAA", [1, 2]), ("AAC", [0, 5])]


GRAPH = "2\t3\t31\t1\nNODE\t1\t4\t20\t20\t0\t0\nACGT\nACGT\nNODE\t2\t3\t9\t9\t0\t0\nTTT\nAAA\nARC\t1\t-2\t5\nNR\t-1\t2\n7\t0\t3\n8\t1\t4\nNR\t2\t1\n9\t2\t5\n"


def test_graph_text(spark, tmp_path):
    (tmp_path / "g").write_text(GRAPH)
    g = gt.read_graph(spark, str(tmp_path / "g"))
    assert g.k == 31 and sorted(tuple(r) for r in g.nodes.select("node_id", "length", "cov_sum", "ends_fwd", "ends_twin").collect()) == [(1, 4, 20, "ACGT", "ACGT"), (2, 3, 9, "TTT", "AAA")]
    assert [tuple(r) for r in g.arcs.collect()] == [(1, True, 2, False, 5)]
    assert sorted((r.node_id, r.read_id, r.offset, r.start_coord, r.fwd) for r in g.noded_reads.collect()) == [(1, 7, 0, 3, False), (1, 8, 1, 4, False), (2, 9, 2, 5, True)]
    gt.save_graph(g, str(tmp_path / "saved"))
    assert gt.load_graph(spark, str(tmp_path / "saved")).nodes.count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "ACGTACGT"), ("a", "AC")], "name string, seq string")
    sinks.write_fasta(df, str(tmp_path / "f"), ["name"], width=4)
    assert [r.seq for r in sf.read_fasta(spark, str(tmp_path / "f")).sort("name").collect()] == ["AC", "ACGTACGT"]
    assert sinks.fasta_lines(df, width=4).first().value == ">b\nACGT\nACGT"
    lines = [r.value for r in sinks.dot_lines(graph(spark, "12 23"), starts=[1]).sort("ord", "value").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and sum("->" in x for x in lines) == 2 and any("red" in x for x in lines)


def test_gap_is_filled(spark):
    s = random_seq(400, 5)
    gappy = s[:180] + "N" * 40 + s[220:]
    reads = spark.createDataFrame([(i, s[i : i + 80]) for i in range(0, 321, 2)], "read_id long, seq string")
    scaffolds = spark.createDataFrame([(0, "x", gappy)], "scaffold_idx int, name string, seq string")
    r = pl.gapfill(scaffolds, reads, k=21, coverage_cutoff=0, overhang=50, leash=500).first()
    assert r.filled == 1 and r.seq == s


def test_ends_connect(spark):
    s = random_seq(700, 6)
    reads = spark.createDataFrame([(i, s[i : i + 80]) for i in range(0, 621, 2)], "read_id long, seq string")
    scaffolds = spark.createDataFrame([(0, "a", s[:300]), (1, "b", s[400:])], "scaffold_idx int, name string, seq string")
    out = pl.wander(scaffolds, reads, k=21, coverage_cutoff=0, overhang=60, leash=1000)
    c = [(r.seq1, r.side1, r.seq2, r.side2) for r in out["connections"].collect()]
    assert (0, "end", 1, "start") in c or (1, "start", 0, "end") in c


def test_assemble_count_and_orfs(spark):
    g = graph(spark, "12 24 13 34", lengths={n: 60 for n in range(1, 5)})
    assert tuple(pl.count_paths(g).first()) == (2, 2)
    one = graph(spark, "12 23", lengths={n: 60 for n in range(1, 4)})
    r = pl.assemble(one, wk.AssembleOptions(min_contig_size=50, max_tip_length=5)).collect()
    assert len(r) == 1 and r[0].shorthand == "1s,2s,3s" and len(r[0].seq) == 186
    b = pl.assemble(g, wk.AssembleOptions(min_contig_size=50, max_tip_length=5), bubbly=True).collect()
    assert any("{" in x.shorthand for x in b)
    with pytest.raises(ValueError):
        pl.sequence(one, spark.createDataFrame([(1, [1, 3])], "path_id int, path array<int>"))


def test_visualise(spark):
    lines = pl.visualise(graph(spark, "12 23 34"), spark.createDataFrame([(0, 1)], "source int, start int"), 10).where("ord = 1")
    assert lines.count() == 3


def test_explore_and_fluff(spark):
    s = random_seq(500, 7)
    reads = spark.createDataFrame([(i, s[i : i + 80]) for i in range(0, 421, 2)], "read_id long, seq string")
    scaffolds = spark.createDataFrame([(0, "a", s[:250])], "scaffold_idx int, name string, seq string")
    got = pl.explore_ends(scaffolds, reads, spark.createDataFrame([("a", "end")], "name string, side string"), 21, 0, 60, 2000)
    assert got.count() >= 1 and got.where(F.length("seq") > 100).count() >= 1
    assert pl.fluff(scaffolds.select("scaffold_idx", "seq"), reads, 21, 0, 100, 60, 2000).count() >= 1
