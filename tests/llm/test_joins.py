import itertools
import random

import numpy as np
import pandas as pd
import pytest

from strandflow.llm import set_relation_join as sj
from strandflow.llm.latent_decontamination import _gaussian, _leading, common_subsequence, contaminated
from strandflow.llm.shingles import shingle_set
from strandflow.llm.vector_passes import near_duplicate_vectors


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def brute(rows, width=5, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, base = [], [words(rng, rng.choice((3, 8, 40, 200))) for _ in range(30)]
    common = words(rng, 60)
    for n in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        if rng.random() < 0.3:
            w = w + common
        rows.append((n * 7 + 3, " ".join(w)))
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One\x0btwo"), (9005, "one TWO"), (9006, "long " * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")  # a clashing column
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_jaccard_of_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base, rows = words(rng, 60), []
    for n in range(250):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"y{rng.randrange(99999)}"
        rows.append((n, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=10).collect()}
    assert got == brute(rows)


def test_jaccard_of_hot_lists_in_parts_and_of_sets_that_share_a_number(spark):
    rng = random.Random(6)
    base, rows = words(rng, 60), []
    for n in range(250):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"y{rng.randrange(99999)}"
        rows.append((n, " ".join(w)))
    rows += [(1000 + i, t) for i, t in corpus(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.jaccard_components(df, hot=8, key_bits=7).collect()}
    assert got == brute(rows)


def test_jaccard_of_nothing_and_of_repeated_rows(spark, docs_of):
    assert sj.jaccard_components(docs_of([])).count() == 0
    got = sj.jaccard_components(docs_of([(4, "a b c", "s"), (4, "a b c", "s"), (2, "a b c", None)])).collect()
    assert sorted(tuple(r) for r in got) == [(2, 1, 2), (4, 1, 2), (4, 1, 2)]


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and not len(shingle_set(None))
    assert (shingle_set("A B\x0bc d e") == shingle_set("a b c d e")).all()
    assert len(shingle_set("K b c d e")) == 1 and shingle_set("K b c d e")[0] != shingle_set("k b c d e")[0]


def vector_truth(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    ok = {i: np.array(v, float) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    label = {i: la for i, _, la in rows}
    links = {i: [] for i in ids}
    good = sorted(ok)
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if label[a] == label[b] and len(ok[a]) == len(ok[b]):
                c = ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b])
                if c >= threshold:
                    links[a].append(b)
                    links[b].append(a)
    comp = {}
    for i in sorted(ids):
        if i not in comp:
            stack, seen = [i], {i}
            while stack:
                for m in links[stack.pop()]:
                    if m not in seen:
                        seen.add(m)
                        stack.append(m)
            for m in seen:
                comp[m] = min(seen)
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for group in range(60):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((n, (center + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist(), int(group % 3)))
            n += 1
    big = rng.standard_normal(16)
    for _ in range(120):
        rows.append((n, (big + rng.standard_normal(16) * 0.15).astype(np.float32).tolist(), 1))
        n += 1
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 50, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, block=64, chunk=32).collect()}
    assert got == vector_truth(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_without_an_id_and_that_share_one(spark):
    v, w, far = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, None, 1), (5, v, 1), (5, None, 1), (5, far, 1), (None, w, 1), (2, v, 1), (None, [0.0, 0.0, 1.0], 1), (9, v, None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, cls string, kept int")  # clashing columns
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()), key=str)
    want = [(None, 0, None, True), (5, 2, 2, False), (5, 0, 5, True), (5, 0, 5, True), (None, 2, 2, False), (2, 2, 2, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)


def test_vectors_in_clusters_with_small_windows(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((25, 16))  # one label of clusters with sub-clusters
    rows = [(i, (centers[i % 25] + rng.standard_normal(16) * 0.22).astype(np.float32).tolist(), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, passes=1, window=4).collect()}
    want = vector_truth(rows)
    recall = sum(got.values()) / sum(n for n, *_ in want.values())
    print("recall", recall, "of", sum(n for n, *_ in want.values()) // 2)
    assert all(got[i] <= want[i][0] for i in got) and recall >= 0.999


@pytest.mark.parametrize("n, median, pairs", [(20_000, 0.88, 600)])
def test_recall_in_a_tight_label(spark, n, median, pairs):
    """One label around one center; planted pairs at a cosine of 0.94 among vectors that hardly ever reach 0.93."""
    rng, dim = np.random.default_rng(8), 384
    center = rng.standard_normal(dim)
    center /= np.linalg.norm(center)
    off = np.sqrt(1 / median - 1)

    def around(k):
        x = rng.standard_normal((k, dim))
        x -= np.outer(x @ center, center)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    u = around(n)
    share = 1 - (1 - 0.94) / (1 - median)  # of the part off the center
    w = around(pairs)
    w -= (w * u[:pairs]).sum(axis=1, keepdims=True) * u[:pairs]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    u[n - pairs :] = share * u[:pairs] + np.sqrt(1 - share**2) * w
    x = (center + off * u).astype(np.float32)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    assert abs(np.median(unit[:200] @ unit[1000:2000].T) - median) < 0.01
    linked = np.zeros(n, np.int64)
    for lo in range(0, n, 2000):
        linked[lo : lo + 2000] = (unit[lo : lo + 2000] @ unit.T >= 0.93).sum(axis=1) - 1
    pdf = pd.DataFrame({"vec_id": range(n), "embedding": [v.tolist() for v in x], "label": 1})
    df = spark.createDataFrame(pdf, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()}
    recall = sum(got.values()) / linked.sum()
    print("links", linked.sum() // 2, "recall", recall)
    assert linked.sum() >= 2 * pairs * 0.9 and all(got[i] <= linked[i] for i in got) and recall >= 0.95


def test_lcs():
    a, b = "a b c d e f".split(), "x a c d y f a".split()
    assert common_subsequence(a, b) == 4 and common_subsequence(a, []) == 0


def test_decontamination_finds_planted_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    stop = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(stop) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((16, 30, 60)))) for i in range(20)]
    rows, leaks = [], set()
    for d in range(300):
        w = text(rng.choice((20, 100, 600)))
        if d % 10 == 0:
            i, passage = rng.choice(items)
            p = list(passage)
            if d % 20 == 0:  # every eighth word another one
                p[::8] = ["zz"] * len(p[::8])
            at = rng.randrange(len(w))
            w[at:at] = p
            leaks.add((d, i))
        rows.append((d, " ".join(w).upper() if d % 30 == 0 else " ".join(w)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p) + ".") for i, p in items] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == leaks
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_items_that_leak_into_many_documents(spark):
    rng = random.Random(9)
    vocabulary, stop = [f"v{rng.randrange(10**6)}" for _ in range(3000)], ["the", "of", "and", "to", "in", "is"]
    text = lambda n: [rng.choice(stop) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(30) for i in range(20)}
    items[20] = [rng.choice(stop) for _ in range(24)]  # common words only
    rows, leaks = [], set()
    for d in range(300):
        w, leaked = text(rng.choice((20, 100, 600))), None
        if d % 3 == 0:
            leaked = 0
        elif d % 50 == 1:
            leaked = 20
        if leaked is not None:
            p = list(items[leaked])
            if d % 6 == 0:
                p[::8] = ["zz"] * len(p[::8])
            at = rng.randrange(len(w))
            w[at:at] = [*p[:5], "--", *p[5:]]
            leaks.add((d, leaked))
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == leaks


def test_decontamination_of_equal_items_and_templates(spark):
    rng = random.Random(10)
    vocabulary = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    same, template = text(25), text(25)
    items = {i: text(25) for i in range(20)} | {100 + i: same for i in range(8)} | {200 + i: [*template[:12], f"n{i}", *template[12:]] for i in range(9)}
    texts = {i: " ".join(w) for i, w in items.items()} | {107: " ".join(same) + "."}
    planted = {5: same, 50: items[203], 51: items[3]}
    rows = []
    for d in range(60):
        w = text(rng.choice((20, 100, 300)))
        at = rng.randrange(len(w))
        w[at:at] = planted.get(d, [])
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(sorted(texts.items()), "item_id long, text string")
    want = {(5, 100 + i) for i in range(8)} | {(50, 200 + i) for i in range(9)} | {(51, 3)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want


def test_small_factorisation_is_the_svd():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 12)) @ np.diag(0.5 ** np.arange(12)) @ rng.standard_normal((12, 90)) + 1e-6 * rng.standard_normal((400, 90))
    g = _gaussian(90, 22, 5).astype(float)
    singular, basis = _leading(a.T @ (a @ g), g, 6)
    _, want, vt = np.linalg.svd(a)
    assert np.allclose(singular, want[:6], rtol=1e-2)
    assert np.allclose(np.abs(np.sum(basis * vt[:6].T, axis=0)), 1, atol=1e-2)
    assert _leading(np.zeros((5, 3)), np.ones((5, 3)), 2)[1].shape == (5, 0)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: row[j - 1] + 1 if b[j - 1] == x else max(left, row[j]), initial=0))
    return row[-1]


def test_decontamination_finds_paraphrases(spark):
    rng = random.Random(12)
    vocabulary, stop = [f"v{rng.randrange(10**6)}" for _ in range(20_000)], ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(stop) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice((24, 36, 60)))) for i in range(30)]
    rows, planted = [], {}
    for d in range(500):
        w = text(rng.choice((0, 20, 100, 600)))
        if d % 4 == 0:
            i, passage = rng.choice(items)
            p = [x if k % 3 else rng.choice(vocabulary) for k, x in enumerate(passage)]  # two of three words stay: no 4-gram does, under 0.7 of the words
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
            planted[d, i] = p
        elif d % 4 == 1:  # a shared phrase is no leak
            w += rng.choice(items)[1][:7]
        rows.append((d, " ".join(w)))
    leaks = set()  # by brute force: half of the words in order, 0.6 of the words with weight, and of those in the last third
    for (d, i), p in planted.items():
        item = dict(items)[i]
        content, answer = ([x for x in part if x not in stop] for part in (item, item[-(len(item) // 3) :]))
        if subsequence(item, p) >= 0.5 * len(item) and all(sum(x in p for x in part) >= 0.6 * len(part) for part in (content, answer)):
            leaks.add((d, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    print("recall of paraphrases", len(leaks & set(got)) / len(leaks), "of", len(leaks))
    assert len(leaks) >= 50 and len(leaks & set(got)) / len(leaks) >= 0.95 and set(got) <= set(planted)
    assert sum(r.lcs < 0.7 and r.cosine >= 0.35 for r in got.values()) >= 50  # by the latent space alone


def test_decontamination_of_repeated_rows_long_texts_and_other_columns(spark):
    rng = random.Random(13)
    vocabulary = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = {i: text(30) for i in range(10)}
    long = text(150_000) + items[4] + text(2000)
    rows = [(1, " ".join(items[2]), 9, "a"), (1, " ".join(items[2]), 9, "a"), (2, " ".join(long), 9, None), (3, " ".join([*items[5], *text(50), *items[5]]), 9, "b"), (None, " ".join(items[1]), 9, "b"), (4, " -- ".join(text(80)), 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, cosine string")  # clashing columns
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.lcs) for r in contaminated(docs, bench, block_items=4).collect())
    assert got == [(1, 2, 1.0), (2, 4, 1.0), (3, 5, 1.0)]
    assert sorted((r.doc_id, r.item_id, r.lcs) for r in contaminated(docs, bench, block_items=3, max_blocks=1, max_words=100).collect()) == got


def test_jaccard_of_rows_without_an_id(spark, docs_of):
    import corpus_pipeline
    from strandflow.llm.set_relation_join import jaccard_components

    words = [f"w{i}" for i in range(60)]
    other = [f"x{i}" for i in range(60)]
    rows = [(7, " ".join(words), "s"), (None, " ".join(words[:58]), "s"), (None, " ".join(other), "s"), (None, " ".join(other[:58]), "s"), (3, "alone here", "s")]
    got = sorted((tuple(r) for r in jaccard_components(docs_of(rows)).collect()), key=str)
    assert got == sorted([(7, 56, 7), (None, 54, 7), (None, 56, None), (None, 54, None), (3, 1, 3)], key=str)
    kept = [(r.doc_id, r.text[0]) for r in corpus_pipeline.one_of_each_group(spark, docs_of(rows), "").collect()]
    assert sorted(kept, key=str) == [(3, "a"), (7, "w"), (None, "x")]
