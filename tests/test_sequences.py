import random

import pytest
from pyspark.sql import functions as F

from strandflow.functions import sequence as sq
from strandflow.functions import trails as tr
from strandflow.operators import kmers as km
from strandflow.operators import oligos as ol
from strandflow.operators import orfs as of
from strandflow.operators import scaffolds as sc
from strandflow.operators import validation as vl
from strandflow.operators import variants as va
from strandflow.operators.build import build_graph
from strandflow.operators.graph import trail_sequences


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_revcomp_and_codons(spark):
    assert one(spark, sq.revcomp(F.lit("aaCGtN"))) == "NACGTT"
    assert one(spark, sq.translate_codons(F.lit("ATGAAATAA"))) == "MK*"
    with pytest.raises(Exception, match="not a codon"):
        one(spark, sq.translate_codons(F.lit("ATN")))


def test_kmers_of_long_sequences(spark):
    s = "".join(random.Random(1).choices("ACGT", k=2000))
    got = [(r.pos, r.kmer) for r in sq.with_kmers(spark.createDataFrame([(1, s), (2, "ACG"), (3, "")], "id int, seq string"), "seq", 7, piece=64).sort("id", "pos").collect()]
    assert got == [(i, s[i : i + 7]) for i in range(len(s) - 6)]


def test_trail_text(spark):
    assert one(spark, tr.parse_shorthand(F.lit("9s, 12s,7e"))) == [9, 12, -7]
    assert one(spark, tr.shorthand(tr.flip(F.array(*map(F.lit, (9, 12, -7)))))) == "7s,12e,9e"
    with pytest.raises(Exception, match="not an oriented node"):
        one(spark, tr.parse_shorthand(F.lit("9")))


def scaffold(spark, *seqs):
    return spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(seqs)], "scaffold_idx int, name string, seq string")


def test_break_scaffolds(spark):
    s = scaffold(spark, "AAAAANNNGGGNNTTNNAA", "acgrt")
    c = sc.break_scaffolds(s)
    assert [(r.start, r.stop) for r in sc.gaps(c).where("scaffold_idx = 0").sort("gap_no").collect()] == [(6, 8), (12, 13), (16, 17)]
    assert {r.scaffold_idx: r.seq for r in sc.rebuilt(c).collect()} == {0: "AAAAANNNGGGNNTTNNAA", 1: "ACGNT"}
    assert sc.contig_names(c).where("scaffold_idx = 0 and contig_idx = 1").first().contig_name == "s0_2of4_9to11"
    with pytest.raises(Exception, match="no bases"):
        sc.break_scaffolds(scaffold(spark, "NNN")).collect()


def test_end_probes(spark):
    p = sc.end_probes(sc.break_scaffolds(scaffold(spark, "AACCGGTTT")), 3).sort("probe_no").collect()
    assert [(r.probe_no, r.side, r.seq) for r in p] == [(1, "start", "GTT"), (2, "end", "TTT")]


def connections(spark, *rows):
    return sc.canonical_connections(spark.createDataFrame(rows, "seq1 int, side1 string, seq2 int, side2 string, distance int"))


def test_doubly_single(spark):
    c = connections(spark, *[(a, "end", b, "start", 10) for a, b in ((1, 2), (2, 3), (3, 4), (3, 5))])
    assert sorted(r.text for r in sc.connection_text(sc.doubly_single(c)).collect()) == ["1e/2s:10", "2e/3s:10"]
    with pytest.raises(Exception, match="given twice"):
        sc.checked_connections(connections(spark, (1, "end", 2, "start", 1), (2, "start", 1, "end", 2))).collect()


def test_chains(spark):
    c = connections(spark, (1, "end", 2, "start", 5), (2, "end", 3, "start", 6), (3, "end", 1, "start", 7), (9, "end", 8, "end", 3), (7, "end", 7, "start", 2))
    s = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 10)], "seq int")
    got = {}
    for r in sc.chains(s, c).sort("scaffold", "ord").collect():
        got.setdefault((r.scaffold, r.circular), []).append((r.seq, r.fwd, r.gap_after))
    assert got[1, True] == [(1, True, 5), (2, True, 6), (3, True, 7)]
    assert got[8, False] == [(8, True, 3), (9, False, None)]
    assert got[7, True] == [(7, True, 2)] and got[10, False] == [(10, True, None)]
    seqs = spark.createDataFrame([(8, "AAC"), (9, "GGT")], "seq int, sequence string")
    assert sc.scaffold_sequences(sc.chains(seqs.select("seq"), c), seqs).where("scaffold = 8").first().seq == "AAC" + "NNN" + "ACC"


def test_unconnected(spark):
    c = connections(spark, (1, "end", 2, "start", 5))
    s = spark.createDataFrame([(1,), (2,), (3,)], "seq int")
    assert [r[0] for r in sc.unconnected_sequences(s, c).collect()] == [3]
    assert sc.unconnected_ends(s, c).count() == 4


def test_consensus_and_variants(spark):
    al = spark.createDataFrame([("g", 1, "AT-GA"), ("g", 2, "AC-GA"), ("g", 3, "ACTGA")], "g string, path_id int, aln string")
    assert va.consensus(al, "g").first().consensus == "AN-GA"
    ref = spark.createDataFrame([("g", "AA--CCGG")], "g string, aln string")
    alt = spark.createDataFrame([("g", 1, "AATTCC--"), ("g", 2, "TTTTCCGG")], "g string, path_id int, aln string")
    v = va.shorthand(va.variants(ref, alt, "g"))
    assert sorted(r.text for r in v.collect()) == ["0S:TT", "2I:TT", "4D:2"]
    rev = va.shorthand(va.reversed_variants(v.drop("text").withColumn("n", F.lit(6)), "n"))
    assert sorted(r.text for r in rev.collect()) == ["0D:2", "4I:AA", "4S:AA"]
    calls = va.vcf_rows(v.withColumn("r", F.lit("AACCGG")), "g", "r").sort("POS").collect()
    assert [(r.POS, r.REF, r.ALT) for r in calls] == [(1, "AA", "TT"), (2, "A", "ATT"), (4, "CGG", "C")]


def test_calls_over_pieces_of_long_references(spark):
    rng = random.Random(5)
    ref = {g: "".join(rng.choices("ACGT", k=n)) for g, n in (("a", 90), ("b", 16), ("c", 8))}
    rows = [(g, p, *x) for g, s in ref.items() for p in range(len(s) - 7) for x in (("SWAP", s[p : p + 2][::-1], None), ("INSERT", "ACGTTGCAACG", None), ("DELETION", None, min(len(s) - p, 1 + p % 30)))]
    v = spark.createDataFrame(rows, "g string, pos int, type string, seq string, del_len int")
    refs = spark.createDataFrame(list(ref.items()), "g string, r string")
    want = sorted(map(repr, va.vcf_rows(v.join(refs, "g"), "g", "r").collect()))
    assert sorted(map(repr, va.vcf_rows_over(v, refs, "g", "r", piece=8).collect())) == want and len(want) == len(rows)


def test_orf_markers(spark):
    rows = [(1, "+", p, "start") for p in (8, 14, 20)] + [(1, "+", p, "stop") for p in (2, 11, 17, 44)]
    m = spark.createDataFrame(rows, "seq_id int, strand string, pos int, kind string")
    got = sorted((r.start, r.stop) for r in of.pair_markers(m).where("kind = 'pair'").collect())
    assert got == [(8, 11), (14, 17), (20, 44)]


def test_orf_sequences(spark):
    text = "TAA" + "ATG" + "GAA" + "AAA" * 6 + "TAA"
    s = spark.createDataFrame([(1, text), (2, "CCCCCC")], "seq_id int, seq string")
    got = {(r.seq_id, r.kind, r.strand, r.frame): r.orf for r in of.orf_sequences(s, 3).collect()}
    assert got[1, "pair", "+", 0] == text[3:] and got[1, "initial stop", "+", 0] == "TAA"
    assert sorted(r.orf for r in of.proteins(of.orf_sequences(s.where("seq_id = 1"), 9)).where("kind = 'pair'").collect()) == [text[3:]]
    assert of.proteins(of.orf_sequences(s, 9)).where("kind = 'pair'").first().protein == "MEKKKKKK"
    assert got[2, "open", "+", 0] == "CCCCCC" and got[2, "open", "+", 1] == "CCC" and got[2, "open", "-", 0] == "GGGGGG"


def test_patterns(spark):
    p = lambda t: km.parse_pattern(F.lit(t))
    assert one(spark, km.print_pattern(p("10-"))) == "10-"
    assert one(spark, km.same_as(p("10-"), p("10-"))) and not one(spark, km.same_as(p("101"), p("10-")))
    assert one(spark, km.consistent_with(p("10"), p("11"))) and not one(spark, km.consistent_with(p("11"), p("10")))
    with pytest.raises(Exception, match="unequal"):
        one(spark, km.same_as(p("1"), p("10")))


def test_tabulate_and_histogram(spark):
    c = spark.createDataFrame([("a", "AAA", 1), ("a", "AAC", 3), ("b", "AAC", 4)], "sample string, kmer string, count long")
    assert sorted(map(tuple, km.tabulate(c, "sample", ["a", "b"]).collect())) == [("AAA", 1, 0), ("AAC", 3, 4)]
    assert [tuple(r) for r in km.tabulate(c, "sample", ["a", "b"], True, 2).collect()] == [("AAC", 75.0, 100.0)]
    t = spark.createDataFrame([("x", [2121, 0, 0, 1416, 1790, 2229, 2115, 0, 1, 2399])], "kmer string, counts array<long>")
    h = km.profile_histogram(t, 1000).sort("pattern").collect()
    assert len(h) == 633 and h[-1].n == 1 and h[0].n is None


def test_read_selection(spark):
    reads = spark.createDataFrame([(1, "ATGCAAAAAAA"), (2, "ATGCCCCCCCC"), (3, "TTTTTTTTTTT")], "read_id int, seq string")
    w = spark.createDataFrame([("ATGC",)], "kmer string")
    ids = lambda **o: sorted(r.read_id for r in km.select_reads(reads, w, **o).collect())
    assert ids() == [1] and ids(target=None) == [1, 2]
    assert ids(min_leftover=7, target=None) == [1, 2] and ids(min_leftover=8, target=None) == []
    assert ids(blacklist=spark.createDataFrame([("CCCC",)], "kmer string"), target=None) == [1]


@pytest.mark.parametrize("k", [1, 3, 8, 31, 33])
def test_spectrum_against_text_slices(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice("ab"), "".join(rng.choices("ACGT" if n % 4 else "ACGTNx", k=rng.randrange(120)))) for n in range(60)] + [("a", None), ("b", ""), (None, "ACGTACGTTTACGATCAGCATCAGACGATCAGCATCAGA")]
    for strands in (True, False):
        want = {}
        for s, t in rows:
            for i in range(len(t or "") - k + 1):
                w = t[i : i + k]
                w = min(w, rc(w.upper())) if strands else w
                want[s, w] = want.get((s, w), 0) + 1
        got = km.spectrum(spark.createDataFrame(rows, "s string, seq string"), k, ["s"], both_strands=strands).collect()
        assert {(r.s, r.kmer): r["count"] for r in got} == want and len(got) == len(want)


def test_path_filter_on_both_strands(spark):
    rng = random.Random(8)
    paths = [(i, "".join(rng.choices("ACGTN" if i % 9 == 0 else "ACGT", k=rng.randrange(30)))) for i in range(80)]
    for k in (5, 33):
        paths = paths if k == 5 else [(i, t * 3) for i, t in paths]
        every = {}
        for _, t in paths:
            for i in range(len(t) - k + 1):
                w = min(t[i : i + k], rc(t[i : i + k]))
                every[w] = every.get(w, 0) + 1
        table = {w: n for w, n in every.items() if rng.random() < 0.9}
        for least in (2, 0):
            bad = lambda t: any(table.get(min(t[i : i + k], rc(t[i : i + k])), 0) < least for i in range(len(t) - k + 1))  # noqa: E731, B023
            df = spark.createDataFrame([(w, [n]) for w, n in table.items()] or [("A", [1])], "kmer string, counts array<long>")
            got = km.filter_paths(spark.createDataFrame(paths, "path_id int, seq string"), df, [least], k, both_strands=True)
            assert sorted(r.path_id for r in got.collect()) == [i for i, t in paths if not bad(t)]


def test_gap_probes(spark):
    s = scaffold(spark, "AACCNNGGTTTNAAANCCCCCC")
    got = sorted((r.gap_no, r.left, r.right) for r in sc.gap_probes(s, 3).collect())
    assert got == [(0, "ACC", "AACC"), (2, "AAA", "GGGG")]  # the third contig is too short to be a gap's right side


def test_path_filter(spark):
    p = spark.createDataFrame([(1, "ATAGC"), (2, "AGATC"), (3, "AT")], "path_id int, seq string")
    t = spark.createDataFrame([("ATA", [5]), ("TAG", [5]), ("AGC", [5]), ("AGA", [5])], "kmer string, counts array<long>")
    assert sorted(r.path_id for r in km.filter_paths(p, t, [1], 3).collect()) == [1, 3]


def test_build_graph_of_one_sequence(spark):
    s = "".join(random.Random(3).choices("ACGT", k=300))
    reads = spark.createDataFrame([(i, s[i : i + 60] if i % 2 else rc(s[i : i + 60])) for i in range(0, 241, 3)] + [(1000, s[-60:])], "read_id int, seq string")
    g = build_graph(reads, 21)
    assert g.nodes.count() == 1 and g.arcs.count() == 0
    p = spark.createDataFrame([(1, [1])], "path_id int, path array<int>")
    assert trail_sequences(p, g.nodes, 21).first().seq in (s, rc(s))
    assert g.noded_reads.count() == reads.count()


def test_build_graph_with_a_bubble(spark):
    rng = random.Random(4)
    a, b = "".join(rng.choices("ACGT", k=80)), "".join(rng.choices("ACGT", k=80))
    reads = spark.createDataFrame([(1, a + "A" + b), (2, a + "C" + b)], "read_id int, seq string")
    g = build_graph(reads, 21)
    assert g.nodes.count() == 4 and g.arcs.count() == 4
    kept = build_graph(spark.createDataFrame([(1, a + "A" + b)] * 3 + [(2, a + "C" + b)], "read_id int, seq string"), 21, coverage_cutoff=2)
    assert kept.nodes.count() == 1 and kept.nodes.first().length == 161 - 20
    with pytest.raises(ValueError):
        build_graph(reads, 20)


def test_compare_and_simulate(spark):
    a = spark.createDataFrame([("x", "A"), ("y", "C")], "name string, seq string")
    b = spark.createDataFrame([("x", "A"), ("y", "G")], "name string, seq string")
    assert tuple(vl.compare(a, b).first()) == (1, 1)
    with pytest.raises(Exception, match="one side only"):
        vl.compare(a, b.where("name = 'x'")).collect()
    s = spark.createDataFrame([("q", "ACGT" * 500)], "name string, seq string")
    r = vl.simulate_gaps(s, 1, 10, 20, 100).first()
    assert r.gapped.count("N") == r.length and len(r.gapped) == 2000 and r.gapped[r.start] == "N"


def test_oligos(spark):
    s = spark.createDataFrame([(1, "ATGCGCGATATCGCGTTAGC")], "seq_id int, seq string")
    r = ol.just_below(s, 50.0).first()
    assert s.first().seq.startswith(r.oligo) and r.tm <= 50
    assert all(x.oligo[-1] in "GC" for x in ol.candidates(s, -100, 50, 90, 1).collect())


def test_runs_of_a_batch_come_in_bounded_pieces():
    import pyarrow as pa

    texts = ["ACN" * 40_000, "NNA" + "CGN" * 3 + "TT", "A" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, 6]), pa.array(["x", "y", "z"]), pa.array(texts)], ["i", "n", "s"])
    found = list(sc._runs()(iter([batch])))
    assert max(b.num_rows for b in found) <= 1 << 14
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["scaffold_idx"], r["contig_idx"], r["start"], r["stop"], r["seq"]) for r in rows[:2]] == [(4, 0, 1, 2, "AC"), (4, 1, 4, 5, "AC")]
    assert len(rows) == 40_000 + 4 + 1 and [r["contig_idx"] for r in rows[:40_000]] == list(range(40_000)) and {r["contigs"] for r in rows[:40_000]} == {40_000}
    assert [(r["start"], r["stop"], r["seq"]) for r in rows[40_000:]] == [(3, 5, "ACG"), (7, 8, "CG"), (10, 11, "CG"), (13, 14, "TT"), (1, 9, "A" * 9)]


def test_frames_of_whole_sequences_need_no_shuffle(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ACGTACGTACGTNatg") for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [(60, None), (61, "ATGTAA"), (62, "TAATAGATG"), (63, "\u00e9ATGAAATAA\u20ac")]
    seqs = spark.createDataFrame(rows, "seq_id int, seq string")
    for least in (0, 9, 30):
        found = of.paired_codons(seqs, least)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, of.pair_markers(of.codon_markers(seqs), least).collect()))


def test_variants_against_columns(spark):
    rng, rows, refs, want = random.Random(9), [], [], set()
    for g in "xyz":
        ref = "".join(rng.choice("ACG-" if g == "x" else "ACGTN--\u20ac") for _ in range(300))
        refs.append((g, ref))
        for i in range(6):
            alt = list(ref[: rng.choice([1, 150, 300])] + "ACG" * rng.randrange(9))
            for _ in range(rng.randrange(1, 6)):
                at, n = rng.randrange(len(alt)), rng.randrange(1, 40)
                alt[at : at + n] = [rng.choice("ACGTN-") for _ in alt[at : at + n]]
            rows.append((g, i, "".join(alt)))
            pos, held = 0, {"INSERT": [], "SWAP": [], "DELETION": []}
            for a, b in zip(ref, alt):
                kind = "INSERT" if a == "-" else "DELETION" if b == "-" else "SWAP"
                if a != b:
                    islands = held[kind]
                    if islands and pos - islands[-1][1] == (kind != "INSERT"):
                        islands[-1][1:] = [pos, islands[-1][2] + b]
                    else:
                        islands.append([pos, pos, b])
                pos += a != "-"
            want |= {(g, first, kind, None if kind == "DELETION" else s, len(s) if kind == "DELETION" else None) for kind, xs in held.items() for first, _, s in xs}
    found = va.variants(spark.createDataFrame(refs, "g string, aln string"), spark.createDataFrame(rows, "g string, path_id int, aln string"), "g")
    got = [tuple(r) for r in found.select("g", "pos", "type", "seq", "del_len").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate") == 0  # no row for each base


def test_short_kmers_of_paths_are_not_shuffled(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ACGT" if i % 3 else "ACGTN") for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, "acgta"), (82, "\u00e9ACG")]
    df = spark.createDataFrame([r for r in rows if r[0] < 81], "path_id int, seq string")
    for k, both in ((4, True), (4, False), (5, True)):
        name = lambda w: min(w, rc(w)) if both else w
        words = {i: [name(s[j : j + k]) for j in range(len(s) - k + 1)] for i, s in rows[:80]}
        table = km.spectrum(df, k, [], both_strands=both).select("kmer", F.array("count").alias("counts"))
        n = {r.kmer: r.counts[0] for r in table.collect()}
        table = spark.createDataFrame(table.collect(), table.schema)
        assert n == {w: sum(x.count(w) for x in words.values()) for x in words.values() for w in x}
        found = km.filter_paths(df, table, [6], k, both_strands=both)
        assert "code#" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.path_id for r in found.collect()} == {i for i, x in words.items() if all(n[w] >= 6 for w in x)} | {80}


def test_depths_of_short_kmers_are_not_shuffled(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("ACGT" if i % 4 else "ACGTNa\u00e9") for _ in range(rng.randrange(0, 60)))) for i in range(50)] + [(50, None), (51, "ACGT")]
    df = spark.createDataFrame(rows, "path_id int, seq string").repartition(3)
    words = {"".join(rng.choice("ACGT") for _ in range(5)) for _ in range(300)}
    for both, odd, big in ((False, [], 1), (True, [], 1 << 40), (False, ["ACNGT", "CGa\u00e9A", "ACG"], 1), (True, ["ACNGT"], -1)):
        named = {min(w, rc(w)) if both else w: (i * big, i + 1) for i, w in enumerate([*sorted(words), *odd, *[s[:5] for _, s in rows[:20:4] if odd and not both]])}
        table = spark.createDataFrame([(w, [*n]) for w, n in named.items()], "kmer string, counts array<long>")
        found = km.depths(df, table, 5, 2, both_strands=both)
        if not odd:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "hashpartitioning" not in plan
        of = lambda w: named.get(w) or (named.get(rc(w)) if both else None) or (0, 0)
        assert sorted(map(tuple, found.collect())) == sorted((i, p, *of(s[p : p + 5])) for i, s in rows if s for p in range(len(s) - 4))
    twice = spark.createDataFrame([("ACGTA", [1]), ("ACGTA", [2])], "kmer string, counts array<long>")
    assert sorted(r.coverage1 for r in km.depths(spark.createDataFrame([(1, "ACGTAC")], "path_id int, seq string"), twice, 5, 1).collect()) == [0, 1, 2]


def test_reads_are_selected_by_bits_of_short_kmers(spark):
    rng = random.Random(12)
    rows = [(f"r{i:03}", "".join(rng.choice("ACGT" if i % 4 else "ACGTNacgt") for _ in range(rng.randrange(0, 60)))) for i in range(90)] + [("s", None), ("t", "\u20acACGTAC")]
    word = lambda n: {"".join(rng.choice("ACGT") for _ in range(5)) for _ in range(n)}
    white, black = word(150), word(8)
    lists = [spark.createDataFrame([(w,) for w in x], "kmer string") for x in (white, black)]
    reads = spark.createDataFrame(rows, "read_id string, seq string").repartition(3)
    for target, least in ((2, 3), (1, 0), (None, 20)):
        taken, want = {}, set()
        for i, s in sorted((i, s or "") for i, s in rows):
            at = [(j, s[j : j + 5]) for j in range(len(s) - 4)]
            if not any(w in black or rc(w) in black for _, w in at):
                for w in {min(w, rc(w)) for j, w in at if (w in white or rc(w) in white) and max(len(s) - j - 5, j) >= least}:
                    taken[w] = taken.get(w, 0) + 1
                    want |= {i} if target is None or taken[w] <= target else set()
        found = km.select_reads(reads, *lists, target, least)
        assert "key#" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.read_id for r in found.collect()} == want and want
    odd = spark.createDataFrame([("ACNGT",)], "kmer string")
    assert [r.read_id for r in km.select_reads(spark.createDataFrame([("a", "TTACNGTT"), ("b", "TTACGGTT")], "read_id string, seq string"), odd).collect()] == ["a"]
