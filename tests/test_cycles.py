"""Strongly connected parts, cycles cut open, levels and path counts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import cycles as cy


def parts(edges):
    """node to the set of nodes it can go to and come back from, where there is more than itself."""
    on = {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
    nodes = {n for e in edges for n in e}

    def reach(n):
        seen, stack = set(), [n]
        while stack:
            new = on.get(stack.pop(), set()) - seen
            seen |= new
            stack += new
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: frozenset(m for m in far[n] if n in far[m]) | {n} for n in nodes if any(n in far[m] for m in far[n] if m != n)}


def brute(edges, starts):
    """(levels with ways, least first parent levels, max paths, min paths, cut edges) by the definition."""
    edges = sorted(set(edges))
    depth, front = {s: 0 for s in starts}, list(starts)
    while front:
        new = []
        for n in front:
            for a, b in edges:
                if a == n and b not in depth:
                    depth[b] = depth[n] + 1
                    new.append(b)
        front = new
    edges = [e for e in edges if e[0] in depth]
    cut, left = [e for e in edges if e[0] == e[1]], [e for e in edges if e[0] != e[1]]
    while found := parts(left):
        head = {p: min(p, key=lambda n: (depth[n], n)) for p in set(found.values())}
        left = [(a, b) for a, b in left if a in found and found[a] == found.get(b)]
        cut += [(a, b) for a, b in left if head[found[b]] == b]
        left = [(a, b) for a, b in left if head[found[b]] != b]
    kept = [e for e in edges if e not in set(cut)]
    on = {n: [b for a, b in kept if a == n] for n in depth}
    tips = {n for n in depth if not on[n] and n not in {a for a, _ in cut}}

    def leads(n, goal):
        return n in goal or any(leads(m, goal) for m in on[n])

    opened = {n for n in depth if leads(n, tips)}
    below, stack = set(), [m for n in opened for m in on[n] if m not in opened]
    while stack:
        n = stack.pop()
        if n not in below:
            below.add(n)
            stack += on[n]

    def level(n):
        ways = [m for m in on[n] if n not in opened or m in opened]
        return (1 + max(level(m)[0] for m in ways), sum(level(m)[1] for m in ways)) if ways else (0, 1)

    known = {n: level(n) if n not in below else (None, None) for n in depth}
    entered = {b for _, b in kept}
    most = sum(known[s][1] or 0 for s in set(starts) if s not in entered)
    top = max((v for v, _ in known.values() if v is not None), default=-1)
    live, least = set(), 0
    for at in range(top + 1):
        here = [n for n in known if known[n][0] == at]
        live |= set(here)
        live -= {b for n in here if at for b in on[n]}
        least = max(least, len(live))
    return known, most, least, set(cut)


CASES = [
    ([(1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7)], [1, 2], 4, 2),
    ([(1, 2), (1, 3), (1, 4), (3, 5), (4, 5), (5, 6), (5, 7), (6, 8), (7, 8), (2, 8)], [1], 5, 3),
    ([(1, 2), (2, 3), (2, 4), (3, 2), (3, 4)], [1], 2, 1),
    ([(1, 2), (2, 3), (3, 2), (3, 4), (4, 2), (4, 5)], [1], 1, 1),
    ([(1, 2), (2, 3), (3, 1)], [1], 1, 1),
    ([(1, 2), (2, 2), (2, 3)], [1], 1, 1),
    ([(1, 2), (2, 3), (3, 2)], [1], 1, 1),
]


def found(spark, edges, starts):
    lv = cy.levels(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in starts], "node int"))
    known = {r.node: (r.level, None if r.ways is None else int(r.ways)) for r in lv.nodes().collect()}
    tails = lv.lists.select(F.col("head").alias("src"), "tail")
    cut = {(r.tail, r.dst) for r in lv.cut.join(tails, "src").collect()}
    return known, int(lv.max_paths().first()[0]), lv.min_paths().first()[0], cut, lv


@pytest.mark.parametrize("edges, starts, most, least", [CASES[i] for i in (1, 3, 6)])
def test_levels_of_small_graphs(spark, edges, starts, most, least):
    known, most_, least_, cut, lv = found(spark, edges, starts)
    assert (known, most_, least_, cut) == brute(edges, starts) and (most_, least_) == (most, least)
    loops = {}
    for r in lv.cycles().collect():
        loops.setdefault((r.src, r.dst), set()).add(r.node)
    want = {5: {(3, 2): {2, 3}, (4, 2): {2, 3, 4}}, 3: {(3, 2): {2, 3}}}
    assert loops == want.get(max(b for _, b in edges), {})


def test_levels_of_random_graphs(spark):
    rng = random.Random(11)
    edges, starts = [], []
    for g in range(40):
        n, base = rng.randint(2, 9), 100 * g
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        if rng.random() < 0.5:
            edges += [(base + i, base + i + 1) for i in range(n - 1)]
        starts.append(base)
    for i, (more, first, *_) in enumerate(CASES, 50):
        edges += [(100 * i + a, 100 * i + b) for a, b in more]
        starts += [100 * i + s for s in first]
    known, most, least, cut, _ = found(spark, edges, starts)
    assert (known, cut) == (brute(edges, starts)[0], brute(edges, starts)[3])
    assert (most, least) == brute(edges, starts)[1:3]


def test_strongly_connected_parts(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(i, i + 1) for i in range(200, 230)] + [(230, 215), (300, 300)]
    got = {}
    for r in cy.strongly_connected(spark.createDataFrame(edges, "src long, dst long")).collect():
        got.setdefault(r.part, set()).add(r.node)
    assert {frozenset(p) for p in got.values()} == set(parts([e for e in edges if e[0] != e[1]]).values()) and all(p in got[p] for p in got)
    assert cy.strongly_connected(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def test_counts_of_very_many_paths(spark):
    """70 bubbles in a row have 2**70 paths."""
    edges = [e for i in range(0, 210, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    lv = cy.levels(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,)], "node int"))
    assert lv.max_paths().first()[0] == 2**70 and lv.min_paths().first()[0] == 2


def test_a_ring_has_one_path(spark):
    from helpers import graph

    from strandflow.plans import pipelines as pl

    assert tuple(pl.count_paths(graph(spark, "12 23 31")).first()) == (1, 1)


def test_parts_of_any_size_are_solved_alike(spark, monkeypatch):
    """Small parts in a task each, without a round; a part of more nodes than rounds are allowed in rounds."""
    rng = random.Random(5)
    edges = [(base + rng.randrange(7), base + rng.randrange(7)) for base in range(0, 300, 10) for _ in range(10)]
    starts = list(range(0, 300, 10))
    large = edges + [(1000 + i, 1001 + i) for i in range(14)] + [(1005, 1003), (1002, 1008), (1000, 1000)]
    known, most, least, cut, lv = found(spark, large, [*starts, 1000])
    monkeypatch.setattr(cy, "levels", lambda e, s, whole=cy.levels: whole(e, s, 12))
    known_, most_, least_, cut_, both = found(spark, large, [*starts, 1000])
    assert type(both) is cy.BothLevels and (known_, most_, least_, cut_) == (known, most, least, cut) == brute(large, [*starts, 1000])
    assert sorted(both.cycles().collect()) == sorted(lv.cycles().collect())
    monkeypatch.undo()
    monkeypatch.setattr(cy, "spread", lambda *a, **o: 1 / 0)
    assert found(spark, edges, starts)[:4] == brute(edges, starts)
