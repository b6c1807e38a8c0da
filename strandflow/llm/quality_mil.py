"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded (hashed word shapes, hashed words and
simple statistics), a hidden layer h is learned from document labels alone, gated attention
a ~ exp(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted representation is scored.

The classifier is fitted on at most ``sample`` labelled documents of ``sample_bytes`` bytes of text together (all rows with a label and not held
out, the first by a hash of their id); passages of the sample come to the driver, those of the corpus never do. Scoring is one pass over
the documents with a model of about 70 KB. Labels, language, source and id are never inputs.

Defined results: null and empty texts are one passage without words and get that passage's score; documents of any
length are scored whole; repeated rows get equal scores; without labels of both classes the score is the labels'
mean (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, text_batches, written

PASSAGE = 64
SHAPES, WORDS, STATS = 256, 256, 8
WIDTH = SHAPES + WORDS + STATS
RUN = re.compile(r"(.)\1+")
_CLASS = {**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}}


class _Words(dict):
    """A word's row of features, kept for at most ``most`` words."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.rows = most, np.zeros((1 << 12, 6), np.float32)

    def reset(self) -> None:
        if len(self) >= self.most:
            self.clear()

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        shape = RUN.sub(r"\1", "".join(_CLASS.get(c) or ("a" if c.isalpha() and c.islower() else "A" if c.isalpha() else c) for c in word[:40]))
        letters = sum(c.isalpha() for c in word)
        self.rows[k] = (
            xxhash.xxh32_intdigest(shape) % SHAPES, SHAPES + xxhash.xxh32_intdigest(word.lower()) % WORDS,
            min(len(word), 40), sum(c.isupper() for c in word) / len(word), 1 - letters / len(word), any(c.isdigit() for c in word),
        )
        self[word] = k
        return k


def encode(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(passages, WIDTH) features and the number of passages of each text."""
    words.reset()
    split = [t.split() if t else [] for t in texts]
    counts = np.array([max(1, -(-len(s) // PASSAGE)) for s in split])
    lens = np.array([len(s) for s in split])
    idx = np.fromiter((words[w] for s in split for w in s), np.int64, int(lens.sum()))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])

    place = np.arange(len(idx)) - np.repeat(starts, lens)
    passage = np.repeat(first, lens) + place // PASSAGE
    n = int(counts.sum())
    f = words.rows[idx]
    size = np.bincount(passage, minlength=n).astype(np.float32)
    x = np.zeros((n, WIDTH), np.float32)
    for c in (0, 1):
        x[:, : SHAPES + WORDS] += np.bincount(passage * (SHAPES + WORDS) + f[:, c].astype(np.int64), minlength=n * (SHAPES + WORDS)).reshape(n, -1)
    x[:, : SHAPES + WORDS] /= np.maximum(size, 1)[:, None]
    for c in range(2, 6):
        x[:, SHAPES + WORDS + c - 2] = np.bincount(passage, f[:, c], n) / np.maximum(size, 1)
    distinct = np.unique(passage * (1 << 32) + idx)
    x[:, -4] = np.bincount(distinct >> 32, minlength=n) / np.maximum(size, 1)
    x[:, -3] = size / PASSAGE
    x[:, SHAPES + WORDS] /= 8
    lines = np.array([[t.count("\n") / (len(s) + 1), len(set(l := t.split("\n"))) / len(l)] if t else [0, 1] for t, s in zip(texts, split)], np.float32).reshape(-1, 2)
    x[:, -2:] = np.repeat(lines, counts, axis=0)
    x[:, : SHAPES + WORDS] = np.sqrt(x[:, : SHAPES + WORDS])
    return x, counts


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict, x: np.ndarray, counts: np.ndarray):
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.tanh(x @ m["E"] + m["e"])
    t, g = np.tanh(h @ m["V"]), _sig(h @ m["U"])
    s = (t * g) @ m["w"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), counts))
    a = s / np.repeat(np.add.reduceat(s, first), counts)
    z = np.add.reduceat(a[:, None] * h, first)
    return h, t, g, a, z, _sig(z @ m["c"] + m["d"]), first


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 11) -> dict:
    """The model, by Adam on mini-batches of bags; gradients by hand."""
    rng = np.random.default_rng(seed)
    k = hidden // 2
    m = {"E": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, k)), "U": rng.normal(0, hidden**-0.5, (hidden, k)), "w": rng.normal(0, k**-0.5, k), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    m = {n: v.astype(np.float32) for n, v in m.items()}
    mean = {n: np.zeros_like(v) for n, v in m.items()}
    var = {n: np.zeros_like(v) for n, v in m.items()}
    first, step = np.concatenate([[0], np.cumsum(counts)[:-1]]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs)
        for at in np.array_split(order, max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in at])
            bx, bc, by = x[rows], counts[at], y[at]
            h, t, g, a, z, p, bf = _forward(m, bx, bc)
            dl = ((p - by) / len(by)).astype(np.float32)
            dz = np.repeat(dl[:, None] * m["c"], bc, axis=0)
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, bf), bc))
            dtg = ds[:, None] * m["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
            grad = {"E": bx.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "d": dl.sum(keepdims=True)}
            step += 1
            for n, v in grad.items():
                v = v + 1e-5 * m[n]
                mean[n] = 0.9 * mean[n] + 0.1 * v
                var[n] = 0.999 * var[n] + 0.001 * v * v
                m[n] = (m[n] - rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _passages(batches):
    words = _Words()
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            x, counts = encode(part.column(2).to_pylist(), words)
            x = x.astype(np.float16)
            ends = np.cumsum(counts)
            bags = [x[e - c : e].tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(bags, pa.binary())], ["id", "y", "bag"])


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_bytes: int, seed: int) -> dict | float:
    """The model, or a constant score where the labels don't hold both classes. It is fitted on at most ``sample`` labelled documents of ``sample_bytes``
    bytes of text together, in a seeded order; a longer one among them is passed over."""
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .where("y is not null and id is not null")
        .where(F.crc32(F.col("id").cast("string")) % 4 != 2)
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(ids), "id").select(F.col("id").cast("long").alias("id"), "y", F.coalesce("text", F.lit("")).alias("text"))
    rows = written(rows.withColumn("size", F.octet_length("text")).withColumn("mix", F.xxhash64(F.lit(seed), "id", "text")).withColumn("row", F.monotonically_increasing_id()), "q7-sample")
    fits = rows.where(F.col("size") <= sample_bytes).select("row", "size", "mix").orderBy("mix", "row").limit(sample)  # ids may have several rows
    until = Window.orderBy("mix", "row")  # over ``sample`` rows
    fits = fits.withColumn("until", F.sum("size").over(until)).where(F.col("until") <= sample_bytes).select("row")
    bags = sorted(rows.join(F.broadcast(fits), "row").select("id", "y", "text").mapInArrow(_passages, "id long, y double, bag binary").collect())
    forget(rows)
    y = np.array([r["y"] for r in bags], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    parts = [np.frombuffer(bytes(r["bag"]), np.float16).reshape(-1, WIDTH) for r in bags]
    return fit(np.concatenate(parts).astype(np.float32), np.array([len(p) for p in parts]), y, seed=seed)


def _scorer(model):
    def run(batches):
        words, m = _Words(), model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                if isinstance(m, float):
                    score = np.full(part.num_rows, m)
                else:
                    score = _forward(m, *encode(part.column(part.num_columns - 1).to_pylist(), words))[5].astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    accept: float = 0.7, sample: int = 3000, sample_bytes: int = 1 << 24, seed: int = 11,
) -> DataFrame:
    """(id, held_out, score, predicted) for each document."""
    spark = docs.sparkSession
    text_batches(spark)
    model = spark.sparkContext.broadcast(learned(docs, labels, id_col, text_col, label_col, sample, sample_bytes, seed))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scorer(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def _keeper(model, column: int, accept: float):
    score = _scorer(model)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(column)] * 2, ["id", "text"])
            kept = np.concatenate([b.column(1).to_numpy() for b in score([texts])]) >= accept if batch.num_rows else np.empty(0, bool)
            yield batch.filter(pa.array(kept))

    return run


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    accept: float = 0.7, sample: int = 3000, sample_bytes: int = 1 << 24, seed: int = 11,
) -> DataFrame:
    """The documents scored ``accept`` or more, all columns as they were; one pass, nothing is joined back."""
    spark = docs.sparkSession
    text_batches(spark)
    model = spark.sparkContext.broadcast(learned(docs, labels, id_col, text_col, label_col, sample, sample_bytes, seed))
    return docs.mapInArrow(_keeper(model, docs.columns.index(text_col), accept), docs.schema)


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
