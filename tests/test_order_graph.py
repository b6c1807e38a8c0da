"""The queries over the graph of orders, which has forks, steps back, loops, turns and rings, against their SQL and brute force on a small table."""

import random

import pandas as pd
import pytest

from strandflow.plans import tables as tb
from strandflow.plans.registry import ORACLE_SQL, QUERIES

WITH_SQL = [
    "distances_any_direction", "nearest_nodes", "nodes_within_leash", "explore_paths", "gap_paths", "node_heights", "min_path_count", "max_path_count", "range_ends",
    "wander_distances", "cycle_budget_paths", "fluffed_paths", "loop_nodes", "gap_path_steps", "gap_path_counts",
]


@pytest.fixture(scope="module")
def star(tmp_path_factory):
    rng, folder = random.Random(4), tmp_path_factory.mktemp("star")
    rows = [(i, rng.choice([0, 0, 1, 2, 3, 4]), rng.choice("FOPP"), float(rng.randrange(10**5)), pd.Timestamp(2000, 1, 1 + rng.randrange(25)), rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) for i in range(32)]
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    pd.DataFrame(rows, columns=columns).astype({"o_orderdate": "datetime64[us]"}).to_parquet(folder / "orders.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def graph(spark, star):
    g = tb.thread_graph(spark, star)
    after = {}
    for r in g.edges().collect():
        after.setdefault(r.src, []).append(r.dst)
    return after, {r.node_id: r.length for r in g.nodes.collect()}


def test_the_graph_has_every_kind_of_arc(spark, star, graph):
    after, _ = graph
    assert any(n in to for n, to in after.items())  # a loop
    assert any(-m in after and -n in after[-m] for n, to in after.items() for m in to) and all(-n in after[-m] for n, to in after.items() for m in to)
    assert any(m in after and n in after[m] and m != n for n, to in after.items() for m in to)  # a step back


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, star, name):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{star}/orders.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns, rows = [c[0] for c in found.description], found.fetchall()
    got = QUERIES[name](spark, star).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows)) and got


def test_exploration_against_brute_force(spark, star, graph):
    after, length = graph
    want = []
    for r in tb.thread_starts(spark, star).collect():
        stack = [([r.start], length[abs(r.start)] + 30)]
        while stack:
            p, bp = stack.pop()
            if p[-1] in p[:-1] or bp > 90 or p[-1] not in after:
                want.append((r.source, ",".join(str(abs(n)) for n in p), "Loop" if p[-1] in p[:-1] else "Leashed" if bp > 90 else "Dead end / coverage"))
            else:
                stack += [(p + [n], bp + length[abs(n)]) for n in after[p[-1]]]
    assert sorted(tuple(r) for r in QUERIES["explore_paths"](spark, star).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["assembled_contigs", "bubbly_contigs"])
def test_contigs_follow_arcs(spark, star, graph, name):
    after, _ = graph
    steps, nodes = [], set()
    for r in QUERIES[name](spark, star).collect():
        for part in r.shorthand.replace("}", "{").split("{")[::2]:
            path = [int(x[:-1]) * (1 if x[-1] == "s" else -1) for x in part.split(",") if x]
            steps += zip(path, path[1:])
            nodes.update(map(abs, path))
    assert len(steps) > 5 and all(b in after[a] for a, b in steps)


@pytest.mark.parametrize("name", ["wander_distances", "cycle_budget_paths", "fluffed_paths"])
def test_surroundings_give_what_whole_parts_give(spark, star, monkeypatch, name):
    from strandflow.operators import walkers as wk

    want = sorted(map(repr, QUERIES[name](spark, star).collect()))
    whole = wk.per_component
    monkeypatch.setattr(wk, "per_component", lambda *a, **o: whole(*a, **{**o, "largest": 3}))
    assert sorted(map(repr, QUERIES[name](spark, star).collect())) == want


def test_a_single_order_that_leads_to_itself(spark, tmp_path):
    con = pytest.importorskip("duckdb").connect()
    rows = [(7, 1, "P", 1015.0, pd.Timestamp(2000, 1, 1), "3-MEDIUM"), (8, 2, "F", 1010.0, pd.Timestamp(2000, 1, 1), "3-MEDIUM")]
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    pd.DataFrame(rows, columns=columns).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = [tuple(r) for r in QUERIES["wander_distances"](spark, str(tmp_path)).select("p1", "p2", "distance").collect()]
    assert got == con.execute(ORACLE_SQL["wander_distances"]).fetchall() == [(2, 3, 26)]
