from decimal import Decimal

import pytest

from helpers import graph, local, paths
from strandflow.operators import graph as gr
from strandflow.operators import pairs as pr
from strandflow.operators import cycles as cy
from strandflow.operators import traverse as tv


def forward(spark, edges):
    return spark.createDataFrame([(int(e[0]), int(e[1])) for e in edges.split()], "src int, dst int")


def starts(spark, *nodes):
    return spark.createDataFrame([(0, n) for n in nodes], "source int, start int")


def as_dict(df):
    return {r["node"]: r["dist"] for r in df.collect()}


def test_edges_are_closed_under_turning(spark):
    e = {(r.src, r.dst) for r in graph(spark, "12 22 23").edges().collect()}
    assert e == {(-b, -a) for a, b in e} and (1, 2) in e and (-2, -1) in e


def test_min_distances(spark):
    g = graph(spark, "12 23 34")
    assert as_dict(tv.min_distances(g.edges(), g.nodes, starts(spark, 1))) == {1: 0, 2: 0, 3: 10, 4: 20}
    assert as_dict(tv.min_distances(g.edges(), g.nodes, starts(spark, 1), leash=15)) == {1: 0, 2: 0, 3: 10}
    assert as_dict(tv.min_distances(g.edges(), g.nodes, starts(spark, 1), max_nodes=2)) == {1: 0, 2: 0, 3: 10}


def test_max_nodes_keeps_ties(spark):
    g = graph(spark, "12 13 14 25")
    assert as_dict(tv.min_distances(g.edges(), g.nodes, starts(spark, 1), max_nodes=1)) == {1: 0, 2: 0, 3: 0, 4: 0}


def test_paired_neighbours_extend_distances(spark):
    g = graph(spark, "12 34", noded_reads=[(2, 1, True), (4, 2, True), (2, 3, True), (4, 4, True), (2, 5, True), (4, 6, False), (1, 7, True), (3, 8, True), (1, 9, True), (3, 10, True)])
    p = spark.createDataFrame([(a, b) for x in (1, 3, 5, 7, 9) for a, b in ((x, x + 1), (x + 1, x))], "read_id int, pair_id int")
    far = pr.paired_neighbours(g.noded_reads, p, g.nodes, 100)
    rows = {(r.src, r.dst): (r.gap, r.n) for r in far.collect()}
    assert rows[2, -4] == (80.0, 2) and rows[1, -3] == (80.0, 2)
    assert as_dict(tv.min_distances(g.edges(), g.nodes, starts(spark, 1), far_edges=far))[-3] == 80


def test_explore(spark):
    g = graph(spark, "12 23 31 34")
    got = {("".join(map(str, r.path)), r.fate) for r in tv.explore(g.edges(), g.nodes, starts(spark, 1), 7, 1000).collect()}
    assert got == {("1231", "Loop"), ("1234", "Dead end / coverage")}
    got = [(r.path, r.fate) for r in tv.explore(g.edges(), g.nodes, starts(spark, 1), 7, 20).collect()]
    assert got == [([1, 2], "Leashed")]


def test_paths_between(spark):
    g = graph(spark, "12 24 13 34")
    p = spark.createDataFrame([(1, 1, 4)], "pair_id int, start int, stop int")
    found, status = tv.paths_between(g.edges(), g.nodes, p, 100)
    assert paths(r.path for r in found.collect()) == ["124", "134"] and not status.first().max_paths_exceeded
    found, status = tv.paths_between(g.edges(), g.nodes, p, 100, max_paths=1)
    assert not found.collect() and status.first().max_paths_exceeded


def test_range_edges(spark):
    g = graph(spark, "13 23 34 43 45 46")
    got = sorted((r.kind, r.node) for r in tv.range_edges(g.edges(), g.nodes).collect())
    assert got == [("end", 5), ("end", 6), ("start", 1), ("start", 2)]
    ring = graph(spark, "12 23 31")
    assert tv.range_edges(ring.edges(), ring.nodes).count() == 0


def test_connectivity(spark):
    g = graph(spark, "12 34")
    w = spark.createDataFrame([(1,)], "node_id int")
    assert sorted(r[0] for r in tv.connected_to(g.edges(), g.nodes, w).collect()) == [1, 2]
    line = graph(spark, "12 23 34")
    assert sorted(r[0] for r in tv.connected_to(line.edges(), line.nodes, w, 15).collect()) == [1, 2, 3]


def test_coverage_filter(spark):
    g = graph(spark, "12 23 34", lengths={1: 228, 2: 29, 3: 38, 4: 224}, cov_sums={1: 1140, 2: 58, 3: 114, 4: 1120}, noded_reads=[(2, 1, True), (3, 2, True)])
    left = lambda t, *w: gr.coverage_filter(g, t, spark.createDataFrame([(x,) for x in w], "read_id int") if w else None).nodes.count()
    assert (left(0), left(3.5), left(10), left(3.5, 1), left(3.5, 1, 2)) == (4, 2, 0, 3, 4)
    assert gr.coverage_filter(g, 3.5).arcs.count() == 0


def test_trails(spark):
    g = graph(spark, "12 23")
    p = spark.createDataFrame([(1, [1, 2]), (2, [])], "path_id int, path array<int>")
    assert {r.path_id: r.seq for r in gr.trail_sequences(p, g.nodes, 7).collect()} == {1: "A" * 26, 2: ""}
    bad = spark.createDataFrame([(1, [1, 3]), (2, [1, 2, 3])], "path_id int, path array<int>")
    assert [(r.path_id, r.src, r.dst) for r in gr.broken_steps(bad, g.edges()).collect()] == [(1, 1, 3)]


def test_orientation_of_id_lists(spark):
    g = graph(spark, "12 23")
    p = spark.createDataFrame([(1, [3, 2, 1]), (2, [1, 2])], "path_id int, ids array<int>")
    assert {r.path_id: r.path for r in gr.orient_ids(p, g.edges()).collect()} == {1: [-3, -2, -1], 2: [1, 2]}
    with pytest.raises(Exception, match="not one orientation"):
        gr.orient_ids(spark.createDataFrame([(1, [1, 3])], "path_id int, ids array<int>"), g.edges()).collect()


def test_probe_lookup(spark):
    g = graph(spark, "12 23", noded_reads=[(1, 1, True), (2, 1, False), (3, 2, True)])
    probes = spark.createDataFrame([(0, 1), (1, 9)], "probe_idx int, read_id int")
    f = gr.find_probes(g.noded_reads, probes)
    assert {r.probe_idx: r.node_id for r in f.collect()} == {0: 1, 1: None}
    assert [r[0] for r in gr.missing_probes(f).collect()] == [2]
    assert {r.node_id for r in gr.find_probes(g.noded_reads, probes, spark.createDataFrame([(2,)], "node_id int")).collect()} == {2, None}


def test_local_graph_reads_arcs_both_ways():
    assert local("12 23").after(-3) == [-2]


def test_unfinished_traversals_raise(spark):
    g = graph(spark, "12 23 34 45 56")
    s = spark.createDataFrame([(1,)], "node int")
    for run in (
        lambda: tv.min_distances(g.edges(), g.nodes, starts(spark, 1), rounds=2), lambda: tv.reachable(g.edges(), s, rounds=2), lambda: tv.explore(g.edges(), g.nodes, starts(spark, 1), 7, 1000, rounds=2),
        lambda: tv.paths_between(g.edges(), g.nodes, spark.createDataFrame([(1, 1, 6)], "pair_id int, start int, stop int"), 1000, rounds=2), lambda: cy.levels(forward(spark, "12 13 24 34 45 46 57 67"), s, rounds=2),
    ):
        with pytest.raises(RuntimeError, match="isn't finished"):
            run()


def test_distances_over_many_rounds(spark, monkeypatch):
    grown = tv._Grown
    monkeypatch.setattr(tv, "_Grown", lambda tag: grown(tag, 3))  # tables are put together on the way
    arcs = [(n, n + 1) for n in range(1, 12)] + [(3, 9)]
    e = spark.createDataFrame(arcs, "src int, dst int")
    nodes = spark.createDataFrame([(n, 10 if n != 3 else 100) for n in range(1, 13)], "node_id int, length int")
    assert as_dict(tv.min_distances(e, nodes, starts(spark, 1))) == {1: 0, 2: 0, 3: 10} | {n: 110 + 10 * (n - 4) for n in range(4, 9)} | {n: 110 + 10 * (n - 9) for n in range(9, 13)}


def test_only_edges_that_can_be_left_are_kept(spark, monkeypatch):
    kept, plain = {}, tv.written
    monkeypatch.setattr(tv, "written", lambda df, tag: kept.update({tag: plain(df, tag)}) or kept[tag])
    g = graph(spark, "12 23 34 45 51", lengths={1: 90, 2: 10, 3: 40, 4: 10, 5: 60})
    edges = g.edges_as_they_come().unionByName(g.edges())  # some come twice
    assert as_dict(tv.min_distances(edges, g.nodes, starts(spark, 1), leash=30)) == {1: 0, 2: 0, 3: 10}
    assert sorted((r.src, r.dst) for r in kept["dist-steps"].collect()) == [(-4, -3), (-2, -1), (-1, -5), (1, 2), (2, 3), (4, 5)]


def test_tasks_grow_in_number_with_rows(spark):
    from strandflow.lineage import dealt

    df = spark.range(10)
    assert [dealt(df, n, "id", most=100).rdd.getNumPartitions() for n in (10, 400, 401, 5000)] == [4, 4, 5, 50]


def test_arcs_are_grouped_by_tasks_of_bounded_size(spark, monkeypatch):
    from strandflow.plans import tables as tb

    asked, plain = [], tb.dealt
    monkeypatch.setattr(tb, "dealt", lambda df, rows, *keys: asked.append((rows, keys)) or plain(df, rows, *keys, most=1000))
    n = tb.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    arcs = tb.arcs(spark, "/root/testdata/sf0.001")
    assert [x[0] for x in asked] == [n, n] and arcs.rdd.getNumPartitions() == -(-n // 1000)
