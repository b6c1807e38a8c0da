import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandflow.llm.mixing import _split, mixed
from strandflow.llm.revisits import resolve_revisits
from strandflow.llm.sharding import interleaved_shards, write_shards
from strandflow.llm.temporal_lists import judged, validity_intervals


def targets(sizes, most=3):
    """Water filling, source by source."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > most * sizes[n] + 1e-9}
        if not over:
            out.update(share)
            break
        out.update({n: float(most * sizes[n]) for n in over})
        open_ -= over
    return out


def mixture_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 10, 50))), rng.choice(["big"] * 6 + ["b", "c", "d", None])) for i in range(600)]
    return rows + [(1000, None, "b"), (1001, "", "only-empty"), (1002, "a\x0bb\x1cc", "tiny"), (5, "again and again", "c"), (5, "again and again", "c")]


def test_mixture(docs_of):
    rows = mixture_rows()
    df = docs_of(rows)
    got = mixed(df, block_words=100, shards=5).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.taken == r.size * len(r.copies)
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixed(df.repartition(7), block_words=100, shards=5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    shards = Counter(c.shard for r in got for c in r.copies)
    assert set(shards) <= set(range(5)) and len(shards) == 5
    carried = mixed(df, block_words=100, carry=("doc_id", "text", "source"), broadcast_rows=1)
    assert sorted((r.carried.doc_id, r.taken) for r in carried.collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixed(df.limit(0)).count() == 0


def leaves_of(spark, sizes, seed, shards):
    quotas = spark.createDataFrame(list(enumerate(sizes, 1)), "source_no int, n long")
    return [(r.source_no, r.shard, r.start, r.n) for r in _split(quotas, seed, shards).collect()]


def test_splitting_tree_keeps_quotas(spark):
    sizes = [1, 0, 37, 200, 5]
    got = leaves_of(spark, sizes, "a", 6)
    for no, n in enumerate(sizes, 1):
        stretches = sorted((start, k) for s, _, start, k in got if s == no and k)
        at = 0
        for start, k in stretches:  # disjoint and without gaps: every block in one shard
            assert start == at
            at += k
        assert at == n
    totals = Counter()
    for _, shard, _, k in got:
        totals[shard] += k
    assert set(totals) == set(range(6)) and sum(totals.values()) == sum(sizes) and max(totals.values()) - min(totals.values()) <= 3
    assert got == leaves_of(spark, sizes, "a", 6) and got != leaves_of(spark, sizes, "b", 6)


def test_splitting_tree_draws_hypergeometric_counts(spark):
    sizes, shards, seeds = [12, 30, 6], 2, 60
    counts = defaultdict(list)
    for seed in range(seeds):
        for no, shard, _, k in leaves_of(spark, sizes, f"s{seed}", shards):
            if shard == 0:
                counts[no].append(k)
    pop, draw = sum(sizes), sum(sizes) // 2
    for no, n in enumerate(sizes, 1):
        mean, var = draw * n / pop, draw * n / pop * (1 - n / pop) * (pop - draw) / (pop - 1)
        x = counts[no]
        assert all(0 <= k <= n for k in x) and abs(sum(x) / seeds - mean) <= 4 * (var / seeds) ** 0.5
        assert 0.4 * var <= sum((k - mean) ** 2 for k in x) / seeds <= 2 * var
    assert all(sum(x) == draw for x in zip(*counts.values()))


def test_mixture_follows_the_tree(spark, docs_of, tmp_path):
    """Shards have like shares of every large source, as blocks are drawn; a document's copies come from different rounds; all shards are handed on."""
    from strandflow.llm.queries import op6_hypergeometric_mix

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * 20), rng.choice("ab")) for i in range(3000)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixed(docs_of(rows), block_words=100, shards=4).collect()
    words = Counter()
    for r in got:
        for c in r.copies:
            words[r.source, c.shard] += r.size
    for source in "ab":
        mine = [words[source, shard] for shard in range(4)]
        assert min(mine) > 0.15 * sum(mine) and max(mine) < 0.35 * sum(mine)
    assert len({c.key for r in got for c in r.copies}) == sum(len(r.copies) for r in got)
    for r in op6_hypergeometric_mix(spark, str(tmp_path)).collect():
        drawn = [int(x) for x in r.shards.split(",") if x]
        assert len(drawn) * r.size == r.taken and drawn == sorted(drawn) and set(drawn) <= set(range(16))


def test_shards(spark, docs_of, tmp_path):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(9), rng.choice(["big"] * 8 + ["b", None])) for i in range(500)] + [(7, None, "b"), (8, "same", "b"), (8, "same", "b")]
    got = interleaved_shards(docs_of(rows), shards=6).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(6)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    for s in ("big", "b", None):
        n = Counter(r.shard for r in got if r.source == s)
        assert max(n.values()) - min(n[k] for k in range(6)) <= 2
    clashing = docs_of(rows).selectExpr("*", "1 AS shard", "'x' AS slot", "2 AS r", "0 AS _part", "'y' AS id", "5 AS size")
    assert sorted(map(repr, interleaved_shards(clashing, shards=6).collect())) == sorted(map(repr, got))
    few = interleaved_shards(docs_of(rows[:4]), shards=24).collect()
    assert len({r.shard for r in few}) == 4 and {r.slot for r in few} == {0}
    assert interleaved_shards(docs_of([])).count() == 0
    write_shards(docs_of(rows[:50]), interleaved_shards(docs_of(rows[:50]), shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.com:80/x/?utm_a=1&q=2#f", 10, "response", '"v1"', 5, h(date="10", content_type="text/html", set_cookie="s")),
        (2, "https://a.com/x?q=2", 20, "revisit", 'W/"v1"', None, h(date="20", content_type="text/plain", set_cookie="t")),
        (3, "http://a.com/x?q=2", 200_000, "revisit", '"v2"', None, h(date="3")),
        (4, "http://a.com/x?q=2", 200_001, "revisit", None, 5, None),
        (5, "http://a.com/x?q=2", 200_002, "revisit", None, None, h(date="5")),
        (6, "http://a.com/y", 5, "revisit", '"v1"', None, h(date="6")),
        (7, None, 5, "revisit", '"v1"', None, None), (8, "http://a.com/x?q=2", None, "revisit", '"v1"', None, None),
        (9, "http://a.com/x?q=2", 10, "revisit", '"v1"', None, None), (0, "http://a.com/x?q=2", 10, "revisit", '"v1"', None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, modified long, headers map<string,string>")
    got = {r.record_id: r for r in resolve_revisits(df).collect()}
    assert {i: (r.target_id, r.status) for i, r in got.items()} == {
        2: (1, "resolved"), 3: (1, "mismatch"), 4: (1, "resolved"), 5: (1, "unverified"), 6: (None, "missing"), 7: (None, "missing"), 8: (None, "missing"), 9: (1, "resolved"), 0: (None, "missing"),
    }
    assert got[2].headers == {"date": "20", "content-type": "text/html", "set-cookie": "s"} and got[3].headers == {"date": "3"}
    assert resolve_revisits(df.limit(0)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h.com/{rng.randrange(4)}", rng.randrange(500_000), rng.choice(["response", "revisit"]), None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, modified long, headers map<string,string>")
    clashing = df.selectExpr("*", "1 AS bucket", "'x' AS full", "2 AS count", "'y' AS url_key", "0 AS hit")
    for got in (resolve_revisits(df, 3600), resolve_revisits(clashing, 86_400, hot=7), resolve_revisits(df.withColumn("ts", F.col("ts") % 40), 86_400, hot=3)):
        got = {r.record_id: (r.ts, r.target_id) for r in got.collect()}
        short = max(t for t, _ in got.values()) < 40
        times = {r[0]: r[2] % 40 if short else r[2] for r in rows}
        for i, u, _, kind, *_ in rows:
            if kind == "revisit":
                before = [(times[x[0]], x[0]) for x in rows if x[3] == "response" and x[1] == u and (times[x[0]], x[0]) < (times[i], i)]
                assert got[i] == (times[i], max(before)[1] if before else None)


def test_temporal_lists(spark):
    ev = spark.createDataFrame(
        [("bad.com", "a", 10, True), ("bad.com", "a", 10, True), ("bad.com", "a", 15, True), ("bad.com", "a", 20, False), ("com", "z", 30, True), ("x.bad.com", "b", 12, True), ("BAD.com", "a", 40, True), ("bad.com", "a", 40, False), (None, "a", 1, True)],
        "domain string, category string, ts long, added boolean",
    )
    assert sorted(map(tuple, validity_intervals(ev).where("domain = 'bad.com'").collect())) == [("bad.com", "a", 10, 20)]
    caps = [(i, u, t) for i, (u, t) in enumerate([("http://x.bad.com/", 9), ("http://x.bad.com/", 10), ("http://www.x.bad.com:443/p", 12), ("http://x.bad.com", 20), ("http://q.com", 31), (None, 15), ("http://bad.com", None), ("http://notbad.com", 15)])]
    got = {r.capture_id: (r.matched, r.categories, r.allowed) for r in judged(spark.createDataFrame(caps, "capture_id long, url string, ts long"), ev).collect()}
    assert got == {
        0: ("", "", True), 1: ("bad.com", "a", False), 2: ("bad.com,x.bad.com", "a,b", False), 3: ("x.bad.com", "b", False), 4: ("com", "z", False), 5: ("", "", True), 6: ("", "", True), 7: ("", "", True),
    }
    assert judged(spark.createDataFrame(caps, "capture_id long, url string, ts long"), ev.limit(0)).where("allowed").count() == len(caps)
    clashing = spark.createDataFrame([(*c, "x", 1, True) for c in [*caps, caps[1]]], "capture_id long, url string, ts long, domain string, row int, allowed boolean")
    again = judged(clashing, ev.withColumn("steps", F.lit(1)), broadcast_rows=1).collect()  # the list's names aren't broadcast
    assert {r.capture_id: (r.matched, r.categories, r.allowed) for r in again} == got and len(again) == len(caps) + 1


def test_pipeline_stages(spark, docs_of, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    good = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n))
    item = good(30)
    rows = [(i, good(60), f"s{i % 4}", "en") for i in range(120)]
    rows += [(500 + i, rows[i][1], "s0", "en") for i in range(10)]
    rows += [(600 + i, rows[i][1].replace(rows[i][1].split()[3], "changed"), "s1", "en") for i in range(10, 20)]
    rows += [(700 + i, good(30) + " " + item + " " + good(20), "s2", "en") for i in range(5)]
    rows += [(800 + i, " ".join(f"{w.upper()}!!" for w in good(60).split()), "s3", "en") for i in range(60)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 800)) for i, *_ in rows], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(i >= 800 for i in ids["quality"]) and len(ids["quality"]) == len(rows) - 60
    assert set(ids["ngram_jaccard_join"]) == set(range(120)) | set(range(700, 705))
    assert set(ids["decontamination"]) == set(range(120))
    assert set(ids["mixing"]) <= set(range(120)) and Counter(ids["sharding"]) == Counter(ids["mixing"])
    assert corpus_pipeline.run(spark, d).count() == len(ids["sharding"])
    clashing = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 AS size", "2 AS copies", "'x' AS id", "0 AS n", "'y' AS carried", "'z' AS comp")
    for docs in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, d)
            assert docs.columns == clashing.columns, name
        if before.limit(1).count():
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(ids["mixing"])


def test_pipeline_stages_of_rows_without_an_id_and_that_share_one(spark, docs_of, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(3, text("u"), "s"), (5, text("t"), "s"), (5, text("u"), "s"), (None, text("u"), "s"), (None, text("v"), None), (None, text("v"), "s"), (5, None, "s"), (5, "", "s")]
    kept = sorted(((r.doc_id, (r.text or "-")[:1]) for r in corpus_pipeline.one_of_each_group(spark, docs_of(rows), "").collect()), key=str)
    assert kept == sorted([(3, "u"), (5, "t"), (None, "v"), (5, "-"), (5, "-")], key=str)
    item = " ".join(f"i{n}" for n in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows += [(5, item, "s"), (None, f"{text('q')} {item}", "s")]
    got = sorted((str((r.doc_id, r.text)) for r in corpus_pipeline.decontaminated(spark, docs_of(rows), str(tmp_path)).collect()))
    assert got == sorted(str((i, t)) for i, t, _ in rows[:-2])
    for docs in (docs_of(rows), docs_of([])):
        assert corpus_pipeline.mixture(spark, docs, "").columns == docs.columns
        assert corpus_pipeline.shards(spark, docs, "").count() == docs.count()


def test_temporal_lists_of_hosts_with_many_labels(spark):
    name = "a.b.c.d.e.f.g.h.bad.com"
    ev = spark.createDataFrame([(name, "x", 1, True), (name[2:], "y", 1, True)], "domain string, category string, ts long, added boolean")
    caps = spark.createDataFrame([(1, f"http://{name}/p", 5), (2, f"http://z.{name}", 5), (3, "http://h.bad.com", 5)], "capture_id long, url string, ts long")
    got = {r.capture_id: (r.matched, r.categories, r.allowed) for r in judged(caps, ev).collect()}
    both = (f"{name},{name[2:]}", "x,y", False)
    assert got == {1: both, 2: both, 3: ("", "", True)}


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i])
def test_mixture_of_rows_without_an_id_and_that_share_one(spark, docs_of, ids):
    rows = [(ids(i), "ten words " * 5 if i % 2 else f"ten words {i} " + "w " * 7, "a" if i < 500 else "b") for i in range(1000)]
    got = mixed(docs_of(rows), block_words=100).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 1000 and abs(taken["a"] - 10000 / 3) <= 10 and abs(taken["b"] - 20000 / 3) <= 10
    again = mixed(docs_of(rows).repartition(5), block_words=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def _mixed_and_sharded(spark, corpus_pipeline, docs, folder):
    corpus_pipeline.mixture(spark, docs, "").write.parquet(folder)
    return corpus_pipeline.shards(spark, spark.read.parquet(folder), "").collect()


def test_pipeline_shards_follow_the_tree_and_keep_copies_apart(spark, docs_of, tmp_path, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from strandflow.llm import mixing

    docs = docs_of([(i, f"some words {i}", "a" if i < 750 else "b") for i in range(1000)])  # targets: 1000 and 2000 of 2250 and 750 words
    got = _mixed_and_sharded(spark, corpus_pipeline, docs, str(tmp_path / "tree"))
    places = defaultdict(list)
    for r in got:
        places[r.doc_id].append((r.shard, r.slot))
    twice = [sorted(p) for p in places.values() if len(p) > 1]
    assert len(twice) > 200
    together = sum(x[0] == y[0] for p in twice for x, y in zip(p, p[1:]))
    beside = sum(x[0] == y[0] and y[1] - x[1] <= 3 for p in twice for x, y in zip(p, p[1:]))
    assert together < len(twice) / 5 and beside < len(twice) / 20
    for shard in range(24):
        mine = Counter("a" if r.doc_id < 750 else "b" for r in got if r.shard == shard)
        whole = Counter("a" if r.doc_id < 750 else "b" for r in got)
        assert all(abs(mine[s] - whole[s] / 24) <= 2 for s in "ab")
    again = _mixed_and_sharded(spark, corpus_pipeline, docs.repartition(7), str(tmp_path / "again"))
    result = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert result(again) == result(got)
    real = mixing._split

    def turned(quotas, seed, shards):  # the same draws, dealt to the shards in another order
        return real(quotas, seed, shards).withColumn("shard", F.lit(shards - 1) - F.col("shard"))

    monkeypatch.setattr(mixing, "_split", turned)
    other = _mixed_and_sharded(spark, corpus_pipeline, docs, str(tmp_path / "other"))
    assert Counter(r.doc_id for r in other) == Counter(r.doc_id for r in got) and result(other) != result(got)
