"""Top-k inner products, fill-in-middle texts and repaired conversations against brute force."""

import hashlib
import heapq
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm.impact_topk import ImpactIndex, top_inner_products
from strandflow.llm.middle import Bits, boundaries, fill_in_middle, restored
from strandflow.llm.turn_repair import Automaton, line_digests, repaired


def best(rows, k):
    """(query id, score, candidate id) of each query row's k best, by Python integers."""
    good = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and i % 5 == 0:
            scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for m, j, v in good if m != n and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [4, 1000])
def test_topk_against_brute_force(spark, least):
    rng = random.Random(least)
    near = [rng.gauss(0, 0.2) for _ in range(6)]
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [x + rng.gauss(0, 0.01) for x in near]) for i in range(30)]
    rows += [(i, list(near)) for i in (300, 301, 302, 303)]  # ties
    rows += [(400, None), (405, []), (410, [0.1, None, 0.2]), (415, [float("nan")] * 6), (420, [float("inf")] * 6), (425, [0.5, 0.5]), (430, [0.25, -0.5]), (435, [0.0] * 6), (None, near), (None, near), (300, near), (440, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, row int")
    got = top_inner_products(df, F.col("id") % 5 == 0, least=least, together=7, few=9)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=repr) == best(rows, 5)
    few = top_inner_products(df, F.col("id") % 5 == 0, least=least, block_bytes=500, k=2)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in few.collect()), key=repr) == best(rows, 2)
    assert top_inner_products(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_topk_of_huge_components(spark):
    rows = [(0, [3e12, -1.0]), (1, [2e12, 4.0]), (2, [2e12, 5.0]), (5, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(df, F.col("id") == 0).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 5] and {g[3] for g in got} == {2**63 - 1}


def test_searches_stop_only_on_proof():
    rng = np.random.default_rng(3)
    for spread in (1, 40, 300):
        rows = np.floor(rng.normal(0, spread, (400, 12)))
        queries = np.floor(rng.normal(0, spread, (20, 12)))
        index = ImpactIndex(rows, 16)
        lens = [np.asarray(s[3]) for s in index.segments]
        assert all((a >= b - 1e-3).all() for a, b in zip(lens, lens[1:])) or spread == 1
        for q, may in zip(queries, index.search(queries, np.full(20, -1), 5, 20)):
            assert set(np.argsort(-(rows @ q), kind="stable")[:5]) <= set(may.tolist())


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n, p in ((1, 1.0), (7, 0.5), (512, 0.3), (513, 0.0), (5000, 0.01), (5000, 0.9)):
        flags = rng.random(n) < p
        bits = Bits(n)
        for lo in range(0, n, 64):
            bits.put(lo, flags[lo : lo + 64])
        bits.close()
        assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(flags.sum())) == np.flatnonzero(flags)).all()
    text = "aé b<cd".encode()
    for piece in (8, 1 << 20):
        units, chars = boundaries(np.frombuffer(text * 9, np.uint8), np.arange(0, len(text) * 9, len(text)), piece)
        assert units.rank(np.array([len(text) * 9]))[0] == 9 * 6 and chars.rank(np.array([len(text) * 9]))[0] == 9 * 7


def by_hand(doc, text):
    """(n, form, prefix, middle, output) from the units themselves."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_units(spark):
    rng = random.Random(2)
    some = ["word", "Zé", " ", "\n", "<", "S>", "\U0001f600", "\x00", "ab1", "ſ", "@[`{"]
    rows = [(i, "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id at all"), (1002, "has <M> in it"), (1003, "long " * 30000), (1003, "long " * 30000), (1004, "é" * 5000), (1005, "x" * 5000), (-7, "minus seven <P <S <M")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    for chunk in (100, 1 << 23):
        out = fill_in_middle(df, carry=("doc_id", "output"), chunk=chunk)
        got = out.select("carried.doc_id", "carried.output", "n", "form", "prefix_chars", "middle_chars", out["output"].alias("new"), restored(out["output"], F.col("form")).alias("again")).collect()
        assert all(r.output == "x" for r in got)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.new) for r in got), key=repr) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=repr)
        assert sorted(((r.doc_id, r.again) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {by_hand(i, t)[1] for i, t in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The counts, cost, audit and lines of a conversation's rows (turn, role, text), in order, by a search of all edits."""
    seen, kinds = set(), []
    for _, role, text in rows:
        core = text.strip(SPACES)
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    on = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, at, lines = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(rows) and at in ("", "a"):
            break
        given = [r for r in ("user", "assistant") if r[0] in on[at]]
        for r in given:
            heapq.heappush(heap, (cost + 2, audit + "I", i, on[at][r[0]], (*lines, r + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more, (_, role, text) = kinds[i] == "truncated", rows[i]
                if role[:1] in on[at]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, on[at][role[0]], (*lines, f"{role}:{text}")))
                for r in given:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, on[at][r[0]], (*lines, f"{r}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("piece_rows", [1, 3, 1 << 14])
def test_repair_against_all_edits(spark, piece_rows):
    rng = random.Random(piece_rows)
    texts = ["Yes.", "no", "", " \n", None, "Why?!  ", "é", ".", "\xa0"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "Sys"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.", True))
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c."]) + str(rng.randint(0, 900)), True) for t in range(700)]
    rows += [(98, 1, "user", "the same.", True)] * 300 + [(97, None, None, None, False)]
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, p in rows if c == conv and p]
        want[conv] = cheapest(sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode())))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn int, role string, text string, present boolean, part int, audit string").repartition(5)
    found, pieces = repaired(df, present_col="present", piece_rows=piece_rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    got = {r.conv: [r[n] for n in names] for r in found.collect()}
    digests = {r.conv: r.repaired_sha256 for r in line_digests(pieces).collect()}
    assert {c: (*v, digests[c]) for c, v in got.items()} == want and want[97] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(df.limit(0))[0].count() == 0


def test_vectors_of_the_automaton_are_few():
    auto = Automaton().completed()
    assert len(auto.vectors) < 64 and auto.vectors == Automaton().completed().vectors
