"""k-mers of up to 255 bases and lists ranked by doubling, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from strandflow.functions import longkmers as lk
from strandflow.operators.superkmers import counted, keyed, occurrences, packed_counts
from strandflow.ranking import list_ranks


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def brute(seqs, k):
    out = Counter()
    for s in seqs:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                out[min(w, rc(w))] += 1
    return out


@pytest.mark.parametrize("k", [1, 4, 11, 12, 31, 51, 255])
def test_counts_of_long_kmers(spark, k):
    rng = random.Random(k)
    some = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 700))) for _ in range(40)]
    seqs = some + [rc(s) for s in some[:9]] + some[:3] * 5 + ["A" * 900, "ACGT" * 200, None, "", "acgtn" * 80, "N" * 50, some[0] + "N" + some[1]]
    df = spark.createDataFrame([(s, 7) for s in seqs], "seq string, n int")
    got = {r.kmer: r.n for r in counted(df, k).collect()}
    assert got == brute(seqs, k)
    salted = {r.kmer: r.n for r in counted(df, k, hot=2, cells=500).collect()}
    assert salted == got
    assert {r.kmer: r.n for r in counted(df, k, weight="n").collect()} == {w: 7 * n for w, n in got.items()}


def test_counted_kmers_are_written_nowhere(spark, monkeypatch):
    from strandflow.operators import superkmers as sk

    tables, plain = [], sk.written
    monkeypatch.setattr(sk, "written", lambda df, tag, **o: tables.append(df.columns) or plain(df, tag, **o))
    df = spark.createDataFrame([("ACGTTGCAAGGCTA" * 9,), ("TTGACCATGCAAAC" * 7,)], "seq string")
    assert counted(df, 21, hot=1).count() and tables and not any("kmer" in t for t in tables)


def test_counts_of_busy_minimizers_are_whole_and_come_as_stretches_do(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(900)) for _ in range(6)]
    found = counted(spark.createDataFrame([(s,) for s in seqs * 2], "seq string"), 51, hot=1)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # each k-mer was shuffled, to add its counts up
    found = [r.kmer for r in found.collect()]
    assert Counter(found) == Counter(set(brute(seqs, 51)))
    near = lambda a, b: any(a[d:] == b[: 51 - d] or b[d:] == a[: 51 - d] for d in range(1, 6))
    assert sum(any(near(a, b) for a in found[max(0, i - 6) : i]) for i, b in enumerate(found)) > len(found) / 2  # sorted ones compress badly


def test_lengths_of_kmers(spark):
    df = spark.createDataFrame([("ACGT",)], "seq string")
    for k in (0, 256):
        with pytest.raises(ValueError):
            packed_counts(df, k)
    assert counted(df.limit(0), 51).count() == 0


def test_packed_bytes_order_as_texts():
    rng = np.random.default_rng(4)
    for k in (1, 3, 4, 5, 51):
        codes = rng.integers(0, 4, (200, k)).astype(np.uint8)
        data = lk.packed(codes)
        assert data.shape == (200, lk.width(k)) and (lk.unpacked(data, k) == codes).all()
        words = lk.texts(codes)
        assert np.argsort([bytes(x) for x in data], kind="stable").tolist() == np.argsort(words, kind="stable").tolist()
        assert [rc(w) for w in words] == lk.texts(lk.turned(codes))
        assert lk.smaller(data[:100], data[100:]).tolist() == [a <= b for a, b in zip(words[:100], words[100:])]


def test_minimizers_are_the_same_on_both_strands():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 4, 400).astype(np.uint8)
    for k, m in ((51, 11), (12, 11), (11, 11), (5, 2)):
        assert (lk.minimizers(codes, k, m) == lk.minimizers(lk.turned(codes[None])[0], k, m)[::-1]).all()


def ranks(links):
    on, into = dict(links), {b for _, b in links}
    out = {}
    for a in on:
        if a not in into:
            n, at = 0, a
            while at is not None:
                out[at] = (a, n, False)
                at, n = on.get(at), n + 1
    for a in sorted(on):
        if a not in out:
            at, n = a, 0
            while at not in out:
                out[at] = (a, n, True)
                at, n = on[at], n + 1
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_list_ranks(spark, kind):
    rng = random.Random(3)
    ids = rng.sample(range(-5000, 5000), 3000)
    links, at = [], 0
    for n in (1, 2, 2, 3, 5, 31, 32, 33, 64, 65, 700, 1, 2, 3, 4, 7, 8, 100, 129):
        part, at = ids[at : at + n], at + n
        links += list(zip(part, part[1:]))
    for n in (1, 2, 3, 5, 8, 64, 65, 200):
        part, at = ids[at : at + n], at + n
        links += list(zip(part, part[1:] + part[:1]))
    if kind == "string":
        links = [(str(a), str(b)) for a, b in links]
    for some in (links, [x for x in links if x in links[:9]], []):
        df = spark.createDataFrame(some, f"a {kind}, b {kind}")
        assert {r.node: (r.head, r.pos, r.circular) for r in list_ranks(df, "test").collect()} == ranks(some)


def unitigs(counts, k):
    """The sequences and summed counts of maximal unambiguous stretches, one k-mer after the other; rings as the set of their k-mers."""
    both = set(counts) | {rc(w) for w in counts}
    after = lambda w: [w[1:] + c for c in "ACGT" if w[1:] + c in both]
    before = lambda w: [c + w[:-1] for c in "ACGT" if c + w[:-1] in both]
    name = lambda w: min(w, rc(w))

    def step(w):
        on = after(w)
        return on[0] if len(on) == 1 and len(before(on[0])) == 1 and name(on[0]) != name(w) else None

    out, seen = Counter(), set()
    for w in sorted(counts):
        if w in seen:
            continue
        at, used = rc(w), {w}
        while (n := step(at)) and name(n) not in used:
            at = n
            used.add(name(n))
        at = rc(at)
        seq, used = at, {name(at)}
        while (n := step(at)) and name(n) not in used:
            seq, at = seq + n[-1], n
            used.add(name(n))
        ring = step(at) is not None
        seen |= used
        key = ("ring", *sorted(used)) if ring else min(seq, rc(seq))
        out[key, sum(counts[x] for x in used)] += 1
    return out


@pytest.mark.parametrize("k, n", [(7, 200), (51, 900)])
def test_unitigs_against_brute_force(spark, k, n):
    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(n))
    genome += rc(genome[40:200]) + genome[:120]
    reads = [genome[i : i + 3 * k] for i in range(0, len(genome) - 3 * k, k)] + [genome]
    ring = "".join(rng.choice("ACGT") for _ in range(70))
    reads += [ring + ring[:k], "A" * (k + 3)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    from strandflow.operators.build import build_graph

    for cutoff in (2, 0):
        g = build_graph(df, k, cutoff)
        got = g.unitigs.join(g.nodes, "node_id").collect()
        want = unitigs(brute(reads, k), k)
        if cutoff:
            kept = {}
            for (key, total), _ in want.items():
                words = list(key[1:]) if key[0] == "ring" else [min(w, rc(w)) for w in (key[i : i + k] for i in range(len(key) - k + 1))]
                if total / len(words) >= cutoff:
                    kept |= {w: brute(reads, k)[w] for w in words}
            want = unitigs(kept, k)
        words = lambda s: [min(w, rc(w)) for w in (s[i : i + k] for i in range(len(s) - k + 1))]
        rings = {key[1:] for key, _ in want if key[0] == "ring"}
        mine = Counter((("ring", *sorted(words(r.seq))) if tuple(sorted(words(r.seq))) in rings else r.seq, r.cov_sum) for r in got)
        assert mine == want
    placed = {(r.read_id, r.node_id, r.fwd): (r.start_coord, r.offset) for r in g.noded_reads.collect()}
    g = {r.node_id: r.seq for r in g.unitigs.collect()}
    for (read, node, fwd), (start, offset) in placed.items():
        seq = g[node] if fwd else rc(g[node])
        assert reads[read][start : start + k] == seq[offset : offset + k]
    assert len(placed) >= len(reads)


def test_linked_kmers_of_a_task_are_ranked_as_one(spark, monkeypatch):
    from strandflow.operators import build as bd

    links, plain = [], bd.list_ranks
    monkeypatch.setattr(bd, "list_ranks", lambda df, tag: links.append(df.count()) or plain(df, tag))
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(4000))
    g = bd.build_graph(spark.createDataFrame([(1, seq)], "read_id long, seq string"), 21, track_reads=False)
    assert [r.seq for r in g.unitigs.collect()] == [min(seq, rc(seq))]
    assert 0 < sum(links) < 3980  # each k-mer's two readings had a link of their own


@pytest.mark.parametrize("k, most, bases", [(5, 4, 1 << 18), (21, 3, 40), (21, 256, 1 << 18)])
def test_runs_of_many_texts_are_cut_at_once(monkeypatch, k, most, bases):
    import pyarrow as pa

    from strandflow.operators import build as bd

    calls, plain = [], lk.minimizers
    monkeypatch.setattr(lk, "minimizers", lambda codes, k, m: calls.append(len(codes)) or plain(codes, k, m))
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTACGTACGTACGTN") for _ in range(rng.randrange(0, 150))) for _ in range(30)] + [None, "", "acgt" * 30, "A" * 90, "ACGT" * (k // 4) + "A"] * 2
    m, want = min(11, k - 1), Counter()
    for w, text in enumerate(texts):
        for lo in range(0, len(text or "") - k + 1, bases):
            codes = lk.codes_of(text[lo : lo + bases + k - 1].encode())
            edges = np.flatnonzero(np.diff(codes < 4, prepend=False, append=False))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= k:
                    for value, i, j, flags in bd._spans(plain(codes[a:b], k - 1, m).astype(np.int64), most):
                        want[value, flags, lk.texts(codes[a + i : a + j + k - 1][None])[0]] += w
    found = Counter()
    for batch in bd._runs(k, m, most, bases)([pa.record_batch([pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["seq", "w"])]):
        for value, salt, flags, size, data, n in zip(*(c.to_pylist() for c in batch.columns)):
            found[value, flags, lk.texts(lk.unpacked(np.frombuffer(data, np.uint8)[None], size))[0]] += n
    assert found == want and len(calls) < 30  # not one for each text


def ring_text(ring, k):
    """A ring from its smallest k-mer on, in the direction of the smaller text."""
    turns = [(x[i:] + x[:i]) * (1 + k) for x in (ring, rc(ring)) for i in range(len(ring))]
    text = min(turns, key=lambda x: x[:k])[: len(ring) + k - 1]
    return min(text, rc(text))


@pytest.mark.parametrize("k, n", [(3, 25), (5, 60), (9, 200), (31, 300), (33, 300)])
def test_stretches_over_many_tasks(spark, k, n):
    from strandflow.operators.build import compacted

    rng = random.Random(k)
    genome = "".join(rng.choice("ACGT") for _ in range(n))
    rings = ["".join(rng.choice("ACGT") for _ in range(m)) for m in (20, 90)] if k > 5 else []
    reads = [genome[i : i + 3 * k] for i in range(0, n - 3 * k, k)] + [genome, rc(genome[:50]) + genome[20:60], "A" * (k + 3), "ACGT" * 12, "A" * k + genome[:40] + "T" * k]
    reads += [r * (2 + k // len(r)) for r in rings] + [None, "", "ACGTN", "N" * 40]
    want = Counter()
    for (key, total), m in unitigs(brute(reads, k), k).items():
        if key[0] != "ring":
            want[key, total] += m
            continue
        words = set(key[1:])
        of = next((r for r in rings if min(r2 := (r * (1 + k))[:k], rc(r2)) in words), "ACGT")
        want[ring_text(of, k), total] += m
    df = spark.createDataFrame([(s, 1) for s in reads], "seq string, w int")
    for options in ({}, {"hot": 1, "cells": 1, "block": 3}, {"m": 3, "cells": 1}):
        assert Counter((r.seq, r.cov_sum) for r in compacted(df, k, **options).collect()) == want, options


@pytest.mark.parametrize("k", [1, 4, 7, 33])
def test_occurrences_meet_their_keys(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTACGTACGTNaé") for _ in range(n)) for n in (0, 3, 30, 200)] + ["ACGT" * 30, None]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)], "id long, seq string, pos string")
    words = sorted({s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1)} | {"ACGTT", "N"})
    names = keyed(spark.createDataFrame([(w,) for w in words], "kmer string"), k)
    got = sorted((r.id, r.pos, r.kmer) for r in occurrences(df, k, "seq", "id", piece=16).join(names, "key").select("id", "pos", "kmer").collect())
    assert got == sorted((i, p, s[p : p + k]) for i, s in enumerate(seqs) if s for p in range(len(s) - k + 1))
