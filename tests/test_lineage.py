import random

import pytest

from strandflow import lineage


@pytest.mark.parametrize("n, m, seed", [(200, 150, 1), (200, 240, 2), (400, 399, 3)])
def test_components_against_union(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(m)] if seed == 3 else [(rng.randrange(n) - 50, rng.randrange(n) - 50) for _ in range(m)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        if x != y:
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in lineage.connected_components(df, "a", "b", "test").collect()}
    assert got == {x: root(x) for x in up}


def test_components_over_several_chunks(spark, monkeypatch):
    whole = lineage._stars
    monkeypatch.setattr(lineage, "_stars", lambda: whole(1))  # a chunk for each Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
        got = {r.node: r.component for r in lineage.connected_components(df, "a", "b", "test").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_components_of_texts(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string")
    got = {r.node: r.component for r in lineage.connected_components(df, "a", "b", "test").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_components_of_no_edges(spark):
    assert lineage.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b", "test").count() == 0


def test_neighbours_in_one_task_need_no_rounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 3000) if i % 10 != 9], "a int, b int").coalesce(1)
    monkeypatch.setattr(lineage, "connected_components", lambda *a, **o: 1 / 0)
    got = {r.node: r.component for r in lineage.near_components(df, "a", "b", "test").collect()}
    assert got == {i: i // 10 * 10 for i in range(3000)}


def test_parts_that_are_dealt_over_tasks_meet_at_their_centers(spark):
    pairs = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(3, 3), (25, 21)]
    df = spark.createDataFrame(pairs[::-1], "a int, b int").repartition(7)
    rows = lineage.near_components(df, "a", "b", "test").collect()
    assert sorted((r.node, r.component) for r in rows) == [(i, i // 20 * 20) for i in range(60)]
