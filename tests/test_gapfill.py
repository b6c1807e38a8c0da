import random

import pytest

from strandflow.operators import alignment as al
from strandflow.plans import pipelines as pl


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def random_seq(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def reads_of(spark, *seqs, step=3):
    return spark.createDataFrame([(i, r) for i, r in enumerate(s[i : i + 80] for s in seqs for i in range(0, len(s) - 79, step))], "read_id long, seq string")


def scored(columns, a, b):
    return sum(2 if i >= 0 <= j and a[i] == b[j] else -3 if i >= 0 <= j else -4 for i, j in columns)


def best(a, b):
    row = [-4 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [row[0] - 4]
        for j, y in enumerate(b):
            new.append(max(row[j + 1] - 4, new[j] - 4, row[j] + (2 if x == y else -3)))
        row = new
    return row[-1]


def whole(columns, a, b):
    return [i for i, _ in columns if i >= 0] == list(range(len(a))) and [j for _, j in columns if j >= 0] == list(range(len(b)))


def test_alignment_is_the_best():
    rng = random.Random(1)
    for _ in range(150):
        a = "".join(rng.choices("ACGT", k=rng.randrange(1, 14)))
        b = "".join(rng.choices("ACGT", k=rng.randrange(1, 14))) if rng.random() < 0.5 else a[:4] + a[6:] + "A"
        found = al._table(a, b, 2, -3, -4)
        assert whole(found, a, b) and scored(found, a, b) == best(a, b)
        assert whole(al.align_two(a, b), a, b)
    assert al.align_two("", "AC") == [(-1, 0), (-1, 1)] and al.align_two("", "") == []


def test_long_alignments_are_cut_at_shared_words(monkeypatch):
    monkeypatch.setattr(al, "CELLS", 2000)
    a = random_seq(3000, 2)
    b = a[:500] + "T" + a[501:1200] + a[1260:2000] + "ACGTACGG" + a[2000:]
    found = al.align_two(a, b)
    assert whole(found, a, b) and scored(found, a, b) >= 2 * len(b) - 400
    other = random_seq(1000, 3)  # nothing in common
    assert whole(al.align_two(a, other), a, other)


def test_all_aligned():
    rows = al.align_all(["ACGT", "ACT", "ATTCGT", ""])
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == ["ACGT", "ACT", "ATTCGT", ""] and al.align_all([]) == []


def applied(text, calls):
    """The text with VCF rows (POS, REF, ALT) applied from the end."""
    for pos, ref, alt in sorted(calls, reverse=True):
        assert text[pos - 1 : pos - 1 + len(ref)] == ref
        text = text[: pos - 1] + alt + text[pos - 1 + len(ref) :]
    return text


def test_gap_between_two_haplotypes_is_filled_by_consensus(spark):
    s = random_seq(500, 5)
    other = s[:240] + ("A" if s[240] != "A" else "C") + s[241:]
    gappy = s[:180] + "N" * 60 + s[300:]
    scaffolds = spark.createDataFrame([(0, "x", gappy), (1, "y", s[:150])], "scaffold_idx int, name string, seq string")
    reads = reads_of(spark, s, other)
    out = pl.gapfill_all(scaffolds, reads, k=21, coverage_cutoff=0, overhang=50, leash=500)
    got = {r.scaffold_idx: r for r in out["scaffolds"].collect()}
    assert got[0].seq == s[:240] + "N" + s[241:] and got[0].filled == 1 and got[1].seq == s[:150] and got[1].filled == 0
    assert [(r.scaffold_idx, r.start, r.stop) for r in out["filled"].collect()] == [(0, 181, 240)]
    calls = [(r.CHROM, r.POS, r.REF, r.ALT) for r in out["variants"].collect()]
    assert {c[0] for c in calls} == {"x"} and {applied(got[0].seq, [c[1:]]) for c in calls} == {s, other}
    one = pl.gapfill(scaffolds, reads, k=21, coverage_cutoff=0, overhang=50, leash=500, max_coverage=True).where("scaffold_idx = 0").first()
    assert one.seq in (s, other) and one.filled == 1
    none = pl.gapfill(scaffolds, reads, k=21, coverage_cutoff=0, overhang=50, leash=500, max_paths=1).where("scaffold_idx = 0").first()
    assert none.seq == gappy and none.filled == 0  # more paths than allowed


@pytest.mark.parametrize("turned", [False, True])
def test_roundup(spark, turned):
    s, u = random_seq(900, 6), random_seq(600, 7)
    alt = s[:450] + s[452:]  # two bases fewer between the scaffolds
    second = s[500:700] + "N" * 30 + s[740:]
    rows = [("one", 0, "a", s[:400]), ("one", 1, "b", rc(second) if turned else second), ("one", 2, "c", u[:300]), ("two", 3, "d", u[:250]), ("two", 4, "e", u[320:])]
    scaffolds = spark.createDataFrame(rows, "genome string, scaffold_idx int, name string, seq string")
    out = pl.roundup(scaffolds, reads_of(spark, s, s, alt, u), k=21, coverage_cutoff=0, overhang=60, leash=1000)
    got = {(r.genome, r.name): (r.header, r.seq) for r in out["scaffolds"].collect()}
    assert set(got) == {("one", "scaffold1"), ("one", "scaffold2"), ("two", "scaffold1")}
    header, text = got["one", "scaffold1"]
    assert header == "scaffold1 scaffold a:b" and got["one", "scaffold2"] == ("scaffold2 scaffold c", u[:300]) and got["two", "scaffold1"] == ("scaffold1 scaffold d:e", u)
    calls = [(r.POS, r.REF, r.ALT) for r in out["variants"].where("genome = 'one' and CHROM = 'scaffold1'").collect()]
    assert len(text) in (len(s), len(alt)) and {text} | {applied(text, [c]) for c in calls} >= {s, alt} or {applied(text, [c]) for c in calls} | {applied(text, calls)} >= {s, alt}
    report = {r.genome: tuple(r)[1:] for r in out["report"].collect()}
    assert report == {"one": (3, 2, 1, 1, 4), "two": (2, 1, 0, 1, 2)}
    alone = pl.roundup(scaffolds, reads_of(spark, s, u), k=21, coverage_cutoff=0, overhang=60, leash=1000, gapfill_only=True)
    assert {r.header for r in alone["scaffolds"].collect()} == {"scaffold1 scaffold a", "scaffold2 scaffold b", "scaffold3 scaffold c", "scaffold1 scaffold d", "scaffold2 scaffold e"}


def test_fills_are_cut_by_places_and_not_by_text(spark):
    """A probe's text occurs everywhere in a run of one base; its place on its node says where the fill begins and ends."""
    from helpers import graph

    g = graph(spark, "12")
    gaps = spark.createDataFrame([(0, 1, 2, "AAAA", "AAA", 3, 2), (1, 1, 2, "AAAA", "AAA", 20, 2), (2, 1, 2, "CAAA", "AAA", 3, 2)], "gap_id long, start int, stop int, left string, right string, left_at int, right_at int")
    found, _ = pl.fills(g, gaps, leash=100)
    assert {r.gap_id: (r.paths, r.fill) for r in found.collect()} == {0: (1, "A" * (26 - 3 - 4 - 3 - 2))}


def test_short_sequences_are_refused_unless_told_to_go_on(spark):
    scaffolds = spark.createDataFrame([(0, "tiny", "ACGT" * 10)], "scaffold_idx int, name string, seq string")
    reads = spark.createDataFrame([(1, "ACGT" * 30)], "read_id int, seq string")
    with pytest.raises(ValueError, match="tiny"):
        pl.wander(scaffolds, reads, k=21, overhang=60)
