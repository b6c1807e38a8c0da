import itertools
import random

import pandas as pd
import pytest

from helpers import graph, local, paths
from strandflow.operators import walkers as wk


# fixed values: small graphs with cycles and the number of their paths
@pytest.mark.parametrize(
    "edges, stop, cycles, n",
    [("12 23 15 53 55 34", 4, 1, 3), ("12 23 15 53 55 34", 4, 0, 2), ("12 23 35 52 15 24 34", 4, 1, 8), ("12 23 32 35 53 54", 4, 1, 5), ("12 22 23 33 32 24", 4, 1, 16)],
)
def test_paths_with_a_cycle_budget(edges, stop, cycles, n):
    found = wk.paths_between(local(edges), 1, stop, 1000, cycles)
    assert len(found.paths) == n and found.circular_paths_detected


@pytest.mark.parametrize("seed", range(8))
def test_walks_against_enumeration(seed):
    rng = random.Random(seed)
    g = wk.LocalGraph.of(7, [(n, rng.choice((10, 15, 20)), 5.0) for n in range(1, 7)], {(rng.randrange(1, 7), rng.choice((1, 1, -1)) * rng.randrange(1, 7)) for _ in range(8)})
    want, stack = [], [[1]]
    while stack:
        p = stack.pop()
        nexts = g.after(p[-1]) if sum(g.length[abs(n)] for n in p) + 6 <= 80 else []
        nexts = [n for n in nexts if not any(a[0] == b[0] and a[2] <= b[1] for a, b in itertools.permutations(named_cycles([*p, n]), 2))]
        stack += [[*p, n] for n in nexts]
        if not nexts:
            want.append(p)
    assert sorted(wk.walks(g, 1, 80, 1, None).paths) == sorted(want)
    assert len(want) < 2 or wk.walks(g, 1, 80, 1, 1) == wk.PathSet([], wk.walks(g, 1, 80, 1, 1).circular_paths_detected, True, wk.walks(g, 1, 80, 1, 1).explored)


def named_cycles(path):
    """(smallest rotation, begin, end) of every return to a node."""
    out = []
    for j, n in enumerate(path):
        back = [i for i in range(j) if path[i] == n]
        if back:
            c = path[back[-1] : j]
            out.append((min(c[r:] + c[:r] for r in range(len(c))), back[-1], j))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_paths_with_a_cycle_budget_against_enumeration(seed):
    rng = random.Random(seed)
    g = wk.LocalGraph.of(7, [(n, rng.choice((10, 15, 20)), 5.0) for n in range(1, 7)], {(rng.randrange(1, 7), rng.choice((1, 1, 1, -1)) * rng.randrange(1, 7)) for _ in range(9)})
    leash, want = 110, []
    stack = [[1]]
    while stack:
        p = stack.pop()
        if p[-1] == 6 and len(p) > 1:
            want.append(p)
            continue
        if sum(g.length[abs(n)] for n in p) > leash:
            continue
        for n in g.after(p[-1]):
            found = named_cycles([*p, n])
            if not any(a[0] == b[0] and a[2] <= b[1] for a, b in itertools.permutations(found, 2)):
                stack.append([*p, n])
    assert sorted(wk.paths_between(g, 1, 6, leash, 1, None).paths) == sorted(want)


def test_self_loop_paths():
    assert paths(wk.paths_between(local("12 23 15 53 55 34"), 1, 4, 1000).paths) == ["1234", "1534", "15534"]


def test_caps_give_nothing():
    s = wk.paths_between(local("12 24 13 34"), 1, 4, 1000, max_paths=1)
    assert s.paths == [] and s.max_path_limit_exceeded
    assert wk.paths_between(local("12 24 13 34"), 1, 4, 1000, max_explore_nodes=1).paths == []
    assert wk.paths_between(local("12 23 34"), 1, 4, 20).paths == []


def test_wander_distances_and_leash():
    g = local("12 23")
    assert wk.wander(g, [1, -2], 100) == {(0, 1): 10}
    assert wk.wander(local("12 23 34 45"), [1, -5], 20) == {}


def test_wander_comes_back_to_its_start():
    for recoherence in (None, 1, 30):
        assert wk.wander(local("11"), [1, -1], 100, recoherence) == {(0, 1): 10}
        assert wk.wander(local("12 21"), [1, -1], 100, recoherence) == {(0, 1): 20}


def test_wander_asks_for_reads_at_forks():
    g = local("12 23 24 45")
    g.reads = {1: {7}, 2: {7}, 4: {7}, 3: set(), 5: {7}}
    assert wk.wander(g, [1, -3], 100, recoherence=30) == {}
    assert wk.wander(g, [1, -5], 100, recoherence=30) == {(0, 1): 30}


def test_tips_and_circles():
    g = local("12 23 24 45 56")
    assert wk.assemble_from(g, [1], wk.AssembleOptions(max_tip_length=15)) == [1, 2, 4, 5, 6]
    assert wk.assemble_from(g, [1], wk.AssembleOptions(max_tip_length=5)) == [1, 2]
    assert wk.assemble_from(local("12 23 31"), [1]) == [1, 2, 3, 1]


def test_assemble_all_takes_each_node_once():
    out = list(wk.assemble_all(local("12 23 34"), wk.AssembleOptions(max_tip_length=5, min_contig_size=0)))
    assert out == [[1, 2, 3, 4]]


def test_bubble_closes():
    m = wk.assemble_bubbly(local("12 23 34 54 25 56 47 67 78"), [1], wk.AssembleOptions(max_tip_length=-1))
    assert m.parts[:2] == [1, 2] and m.parts[3:] == [7, 8]
    assert sorted(m.parts[2].paths()) == [[3, 4], [5, 4], [5, 6]] and m.fate == "dead end"


def test_bubble_that_leads_back_to_its_fork_is_a_circuit():
    g = local("12 23 24 35 45 52 36")  # both ways on from 2 meet at 5, which leads to 2 alone; 6 is a tip
    for limit in (-1, 5, 15):
        m = wk.assemble_bubbly(g, [1], wk.AssembleOptions(max_tip_length=limit, bubble_node_limit=None))
        assert len(m.parts) < 8 and m.fate is not None
    rng = random.Random(1)
    for _ in range(300):
        arcs = [(rng.randint(1, 7), rng.choice((1, 1, -1)) * rng.randint(1, 7)) for _ in range(rng.randint(4, 14))]
        g = wk.LocalGraph.of(7, [(n, 10, 5.0) for n in range(1, 8)], arcs)
        for m in wk.assemble_all_bubbly(g, wk.AssembleOptions(max_tip_length=rng.choice((-1, 5, 25)), min_contig_size=0)):
            assert len(m.parts) < 40 and len(m.by_steps()) < 4000


def test_bubbles_of_many_paths_are_written_as_steps():
    arcs = [(3 * i + a, 3 * i + b) for i in range(40) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4))] + [(1000, 1), (1000, 1001), (1001, 121)]
    g = wk.LocalGraph.of(7, [(n, 1000 if n == 121 else 1, 5.0) for n in {122} | {n for a in arcs for n in a}], [*arcs, (121, 122)])
    m = wk.assemble_bubbly(g, [1000], wk.AssembleOptions(max_tip_length=-1, bubble_node_limit=None, bubble_fork_limit=None, max_bubble_length=10_000))
    assert m.parts[0] == 1000 and m.parts[2:] == [121, 122]
    assert m.by_steps().count(">") == len(arcs) and len(m.nested(g)[1]["nodes"]) == 121


BUBBLES = [  # fixed values: arcs, the contig from node 1 and its fate, where tips of 11 bases are left aside
    ("1-2 2-3 1-4 4-6 6-5 5-3 3-7 7-8", "1s,{2s|4s,6s,5s},3s,7s,8s", "dead end"),  # branches of different length
    ("1-2 2-3 1-4 4-3 3-5 4-99", "1s,{2s|4s},3s,5s", "dead end"),
    ("1-2 2-3 3-4 1-4 3-5 4-5 4-6 5-6 6-7", "1s,{2s,3s,4s|4s|2s,3s,5s|2s,3s,4s,5s|4s,5s},6s,7s", "dead end"),
    ("1-2 2-3 1-4 4-3 3-5 5-6 5-7 6-8 8-9 7-8 7-10 10-9 9-11 11-12 7-99", "1s,{2s|4s},3s,5s,{6s,8s|7s,8s|7s,10s},9s,11s,12s", "dead end"),
    ("1-20 20-21 21-4 1-5 5-4 4-3 3-5 3-8 8-9", "1s,{5s|20s,21s},4s,3s,{5s,4s,3s|},8s,9s", "dead end"),  # a way round the closing node
    ("1-2 2-3 3-1", "1s,2s,3s", "circuit"),
]


@pytest.mark.parametrize("arcs, contig, fate", BUBBLES)
def test_bubbles(arcs, contig, fate):
    arcs = [tuple(map(int, a.split("-"))) for a in arcs.split()]
    g = wk.LocalGraph.of(7, [(n, 100 if n in (8, 20) else 10, 5.0) for n in {n for a in arcs for n in a}], arcs)
    m = wk.assemble_bubbly(g, [1], wk.AssembleOptions(max_tip_length=11))
    assert (m.shorthand(), m.fate) == (contig, fate)
    turned = m.reverse()
    assert turned.reverse().shorthand() == contig and turned.nodes() == {-n for n in m.nodes()}
    assert turned.bp(g) == m.bp(g) and turned.coverage(g) == m.coverage(g) == 5.0


def test_bubble_with_a_way_round_inside():
    g = local("12 24 13 34 25 52")
    m = wk.assemble_bubbly(g, [1], wk.AssembleOptions(max_tip_length=-1))
    assert m.shorthand() == "1s,{2s,5s,2s|2s|3s},4s"


@pytest.mark.parametrize("seed", range(30))
def test_bubble_closes_where_all_ways_meet(seed):
    """Against brute force on acyclic graphs: the nearest node that is on every path from the fork."""
    rng = random.Random(seed)
    arcs = {(a, b) for a in range(1, 10) for b in range(a + 1, 11) if b - a <= 3 and rng.random() < 0.5} | {(n, n + 1) for n in range(1, 10)} | {(1, 3)}
    g = wk.LocalGraph.of(7, [(n, rng.choice((10, 30)), float(n)) for n in range(1, 11)], arcs)
    every, stack = [], [[1]]
    while stack:
        p = stack.pop()
        if p[-1] == 10:
            every.append(p)
        stack += [[*p, n] for n in g.after(p[-1])]
    close = min(set.intersection(*map(set, every)) - {1})
    want = sorted({tuple(p[1 : p.index(close)]) for p in every})
    bubble, at, fate = wk.find_bubble(g, 1, wk.AssembleOptions(max_tip_length=-1))
    assert at == close and fate is None and sorted(map(tuple, bubble.paths())) == want and bubble.nodes() == {n for p in want for n in p}


def test_bubbles_of_many_paths_close():
    arcs = [(3 * i + a, 3 * i + b) for i in range(13) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4))]
    arcs += [(0 + 1000, 1), (1000, 1001), (1001, 40)]  # one more branch round all of them: 2**13 paths and one
    g = wk.LocalGraph.of(7, [(n, 1000 if n == 40 else 1, 5.0) for n in {41} | {n for a in arcs for n in a}], [*arcs, (40, 41)])
    bubble, close, fate = wk.find_bubble(g, 1000, wk.AssembleOptions(max_tip_length=-1, bubble_node_limit=None, bubble_fork_limit=None))
    assert close == 40 and fate is None and sum(1 for _ in bubble.paths()) == 2**13 + 1


def test_assemble_all_through_bubbles():
    def contigs(arcs, **options):
        arcs = [tuple(map(int, a.split("-"))) for a in arcs.split()]
        g = wk.LocalGraph.of(7, [(n, 10, 5.0) for n in {n for a in arcs for n in a}], arcs)
        return [m.shorthand() for m in wk.assemble_all_bubbly(g, wk.AssembleOptions(**({"max_tip_length": -1, "min_contig_size": 0} | options)))]

    assert contigs("1-2 2-3 4-1") == ["4s,1s,2s,3s"]
    assert contigs("1-2 2-3 4-1 11-12 11-13 12-4 13-4 3-21 3-22 21-23 22-23") == ["11s,{12s|13s},4s,1s,2s,3s,{21s|22s},23s"]
    assert contigs("1-2 2-3 4-1 4-5 5-3 6-4") == ["6s,4s,{1s,2s|5s},3s"]
    assert contigs("1-2", min_contig_size=100) == []


def test_seen_ends_are_taken_off():
    m = wk.assemble_bubbly(local("12 13 24 34 45"), [1], wk.AssembleOptions(max_tip_length=-1))
    assert m.shorthand() == "1s,{2s|3s},4s,5s"
    assert m.without_seen_end({5}).shorthand() == "1s,{2s|3s},4s" and m.without_seen_end({4, 5}).shorthand() == "1s" and m.without_seen_end({9}).shorthand() == m.shorthand()
    assert m.without_seen_end({1, 2, 4, 5}).parts == []


def test_tip_distance_is_of_the_longest_way():
    rng = random.Random(2)
    for _ in range(20):
        arcs = {(a, b) for a in range(1, 8) for b in range(a + 1, 9) if rng.random() < 0.4}
        g = wk.LocalGraph.of(7, [(n, rng.randrange(1, 30), 5.0) for n in range(1, 9)], arcs)
        longest = {}
        for n in range(8, 0, -1):
            longest[n] = g.length[n] + max((longest[m] for m in g.after(n)), default=0)
        assert wk.tip_distance(g, 1, 10**9) == longest[1]
    assert wk.tip_distance(local("12 23 32"), 1, 500) > 500  # a cycle is no tip


def test_bubble_limits():
    m = wk.assemble_bubbly(local("12 13 24 35 46 57 68 78"), [1], wk.AssembleOptions(max_tip_length=-1, bubble_node_limit=2))
    assert m.parts == [1] and m.fate == "too many nodes in bubble"
    m = wk.assemble_bubbly(local("12 23 14 43 35"), [1], wk.AssembleOptions(max_tip_length=-1, max_bubble_length=5))
    assert m.parts == [1] and m.fate == "diverges"
    assert wk.assemble_bubbly(local("12 13"), [1]).fate == "dead end"


def test_fluff():
    found = wk.fluff(local("12 23 13 34"), [1], 1000)
    assert sorted(("".join(map(str, p)), f) for p, f in found[0]) == [("1234", "dead_end"), ("134", "dead_end")]
    assert all(f == "beyond_leash" for _, f in wk.fluff(local("12 23 34"), [1], 20)[0])


def test_depth_first_prunes_and_orders():
    seen = []
    wk.depth_first(local("12 13 24 35"), 1, lambda t: seen.append(t[-1]) or t[-1] != 3)
    assert seen == [1, 2, 4, 3]


def test_cycle_counts():
    assert wk.cycle_counts([1, 2, 3, 2, 3, 2, 4])[2, 3] == 2
    assert not wk.cycle_counts([1, 2, 3])


def test_fluff_finds_every_path():
    arcs = [(3 * i + a, 3 * i + b) for i in range(17) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4))]
    g = wk.LocalGraph.of(7, [(n, 1, 5.0) for n in range(1, 53)], arcs)
    assert sum(p[-1] == 52 and f == "dead_end" for p, f in wk.fluff(g, [1], 1000)[0]) == 2**17


def test_groups_are_read_as_one_stream():
    frames = [pd.DataFrame({"group": g, "a": a}) for g, a in (([1, 1, 2], [1, 2, 3]), ([], []), ([2, 2], [4, 5]), ([2, 3], [6, 7]), ([4], [8]))]
    assert [(k, [a for a, in rows]) for k, rows in wk.grouped_rows(frames)] == [(1, [1, 2]), (2, [3, 4, 5, 6]), (3, [7]), (4, [8])]


def test_many_small_parts_are_a_task_s_stream(spark):
    g = graph(spark, "12 23 45 56 78")
    plan = wk.per_component(g, lambda lg: [(n, min(lg.length)) for n in lg.length], "node long, part long")
    assert sorted(map(tuple, plan.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 7)]
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
