"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts writes each document as the sequence of its words' numbers in the benchmark's vocabulary (0 for other
   words), of all items at once. Everything later reads these short sequences; the texts are never read again and never shuffled. Document
   frequencies over the whole corpus give TF-IDF weights. Words of more than ``common`` of all documents, or of many different items, carry no
   weight, except those of items that would be left with too few (``_poor``): a leak into many documents makes an item's own words common.
   Only benchmark words can bring a passage near a benchmark passage, so the matrix has a column for those alone.
2. Distributed randomised SVD: with A the TF-IDF rows of every corpus passage and of the benchmark's, each task
   adds up Y = A'(A G) for a seeded Gaussian G of ``rank`` + ``over`` columns; the small factorisation of Y and G (``_leading``) gives the
   singular values and right singular vectors, and the ``rank`` leading ones are the latent space.
3. Every corpus passage (windows of ``window`` words, half overlapping, whole texts) is projected and compared by
   cosine with the benchmark passages; all above ``cosine`` are candidates. So is every stretch of an item's length that holds
   ``GRAM_SHARE`` of the item's n-grams, whatever its words weigh: verbatim leaks never depend on the weights.
4. In the same task, candidates without enough of the item's content words fall out and the surroundings of the others are checked word by
   word: the longest common subsequence with the item must hold at least ``near`` of its words, or ``para`` of them together with most of
   its content words and of its answer (its last third), which catches paraphrases and leaves shared phrases alone.

Words are numbered for ``max_blocks`` blocks of ``block_items`` items at once, or as many as have ``max_words`` words together; matrices are for one block, so what is
broadcast (the words; a basis of a block's words x ``rank`` floats and the block's items) has a fixed bound at any size of either side.

Defined results: null and empty texts and items match nothing; an item equal to another is checked once and matches where that does;
an item of fewer than ``GRAM`` words matches where it stands word for word; leaks found by n-grams alone have cosine 0;
repeated document rows are reported for each id once an item; rows without an id aren't reported; an empty table on either side gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, parallelism, text_batches, written

STRIP = "\"'`.,;:!?()[]{}<>|*#%&$_-–—…“”‘’«»"


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [x for x in (w.strip(STRIP) for w in (text or "").lower().split()) if x]


GRAM, GRAM_SHARE = 4, 0.4
OTHER, EMPTY = 0, 1  # in sequences: a word of no item, a word of punctuation alone; items' words follow from 2


class _Ids(dict):
    """Number of a raw lower-case word; remembers at most ``most`` words."""

    def __init__(self, vocabulary: dict[str, int], most: int = 1 << 17):
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        plain = word.strip(STRIP)
        self[word] = k = self.vocabulary.get(plain, OTHER) if plain else EMPTY
        return k


def _hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of word numbers."""
    x = (words.astype(np.int64) + 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x94D049BB133111EB) + x[j : j + len(h)]
    return h ^ h >> np.uint64(31)


class _Grams:
    """The n-grams of a block's items by number, each with the items that have it. Items shorter than ``GRAM`` are one gram."""

    def __init__(self, items: list[np.ndarray]):
        self.sizes, self.needs, self.keys, self.seen = [len(w) for w in items], [], {}, {}
        by_n: dict[int, list] = {}
        for i, w in enumerate(items):
            n = min(GRAM, len(w))
            h = np.unique(_hashes(w, n))
            self.needs.append(max(1, int(np.ceil(GRAM_SHARE * len(h)))))
            by_n.setdefault(n, []).append((h, np.full(len(h), i)))
        self.first, owners, total = {}, [], 0
        for n, parts in by_n.items():
            h, i = (np.concatenate(x) for x in zip(*parts))
            self.keys[n], number = np.unique(h, return_inverse=True)
            self.seen[n] = np.zeros(1 << 20, bool)
            self.seen[n][self.keys[n] >> np.uint64(44)] = True
            self.first[n] = total
            owners.append((number + total, i))
            total += len(self.keys[n])
        number, item = (np.concatenate(x) for x in zip(*owners))
        self.owners = item[np.argsort(number, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=total))])

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram number) of the grams in a sequence of vocabulary numbers, which may run over several texts."""
        places, numbers = [], []
        for n, keys in self.keys.items():
            h = _hashes(words, n)
            at = np.flatnonzero(self.seen[n][h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[k] == h[at]
            places.append(at[ok])
            numbers.append(k[ok] + self.first[n])
        return np.concatenate(places), np.concatenate(numbers)

    def stretches(self, pos: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, first and last word) of the surroundings of stretches of one text that hold enough of an item's grams."""
        n = self.starts[gram + 1] - self.starts[gram]
        item = self.owners[np.repeat(self.starts[gram] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = np.sort(item.astype(np.int64) << 32 | np.repeat(pos, n))
        item, pos = key >> 32, key & 0xFFFFFFFF
        size, need = np.array(self.sizes)[item], np.array(self.needs)[item]
        held = np.searchsorted(key, key + size + size // 4 + GRAM) - np.arange(len(key))
        out: list[tuple[int, int, int]] = []
        last = (-1, 0)
        for i, p, z in zip(*(x[held >= need].tolist() for x in (item, pos, size))):
            if i != last[0] or p >= last[1]:  # a region reaches to the end of leaks that begin within an item's length
                out.append((i, max(0, p - z), p + 2 * z + z // 4 + GRAM))
                last = (i, p + z)
        return out


class _Batch:
    """Word numbers of a batch of documents, one after another: ``word`` and, for each, ``doc`` (number in the batch) and ``pos``."""

    def __init__(self, part: pa.RecordBatch, kind: str):
        packed = part.column(1).to_pylist()
        self.word = np.frombuffer(b"".join(packed), kind).astype(np.int32)
        self.lens = np.array([len(x) // np.dtype(kind).itemsize for x in packed])
        self.starts = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(packed)), self.lens)
        self.pos = np.arange(len(self.word)) - self.starts[self.doc]

    def live(self, renumber: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pos, column) of the words with weight."""
        column = renumber[self.word]
        at = np.flatnonzero(column >= 0)
        return self.doc[at], self.pos[at], column[at]

    def region(self, doc: int, lo: int, hi: int) -> list[int]:
        start = self.starts[doc]
        return self.word[start + lo : start + min(hi, self.lens[doc])].tolist()

    def grams(self, grams: _Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pos, gram number) of the n-grams in the texts, in order."""
        real = np.flatnonzero(self.word != EMPTY)
        place, gram = grams.found(self.word[real])
        size = np.zeros(len(gram), np.int64)
        for n, first in grams.first.items():
            size[gram >= first] = n  # numbers ascend by the order of sizes
        inside = self.doc[real[place]] == self.doc[real[place + size - 1]]
        place, gram = real[place[inside]], gram[inside]
        order = np.argsort(place, kind="stable")
        return self.doc[place[order]], self.pos[place[order]], gram[order]


def _windows(doc: np.ndarray, pos: np.ndarray, word: np.ndarray, half: int, least: int):
    """Entries (window, word) of the half-overlapping windows with at least ``least`` hits, and each window's (doc, start)."""
    cell = pos // half
    d = np.concatenate([doc, doc])
    c = np.concatenate([cell, cell - 1])
    w = np.concatenate([word, word])
    ok = c >= 0
    d, c, w = d[ok], c[ok], w[ok]
    keys, inverse, counts = np.unique(d.astype(np.int64) << 32 | c, return_inverse=True, return_counts=True)
    good = counts >= least
    number = np.cumsum(good) - 1
    ok = good[inverse]
    keys = keys[good]
    return number[inverse[ok]], w[ok], keys >> 32, (keys & 0xFFFFFFFF) * half


def _parts(batches, kind: str, rows: int = 250):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, _Batch(part, kind)


def _sequences(vocabulary, kind: str):
    """(id, words): the packed word numbers of every document that has a word of the benchmark."""

    def run(batches):
        ids = _Ids(vocabulary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                found = [t.lower().split() if t else [] for t in part.column(1).to_pylist()]
                found = [np.fromiter(map(ids.__getitem__, w), kind, len(w)) for w in found]
                at = [k for k, w in enumerate(found) if len(w) and w.max() > EMPTY]
                if at:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([found[k].tobytes() for k in at], pa.binary())], ["id", "words"])

    return run


def _frequencies(size: int, kind: str):
    def run(batches):
        df = np.zeros(size, np.int64)
        for _, b in _parts(batches, kind):
            at = np.flatnonzero(b.word > EMPTY)
            seen = np.unique(b.doc[at] << 32 | b.word[at])
            df += np.bincount(seen & 0xFFFFFFFF, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["word", "n"])

    return run


def _gaussian(words: int, rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((words, rank)).astype(np.float32)


def _power(entry: np.ndarray, word: np.ndarray, idf: np.ndarray, g: np.ndarray, z: np.ndarray) -> None:
    """z += A'(A g) for the passages given by (passage number, word) entries; rows of A have length 1."""
    if not len(entry):
        return
    order = np.argsort(entry, kind="stable")
    entry, word = entry[order], word[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(entry)) + 1])
    norm = np.sqrt(np.add.reduceat(idf[word] ** 2, first))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(entry))))
    weight = idf[word] / np.maximum(norm, 1e-9)[row]
    ag = np.add.reduceat(weight[:, None] * g[word], first)
    order = np.argsort(word, kind="stable")
    rows = word[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    z[rows[first]] += np.add.reduceat(weight[order, None] * ag[row[order]], first)


def _sketch(model, window: int, least: int, kind: str):
    def run(batches):
        renumber, idf, width, seed = model.value
        g, z = _gaussian(len(idf), width, seed), np.zeros((len(idf), width), np.float32)
        for _, b in _parts(batches, kind):
            entry, w, *_ = _windows(*b.live(renumber), window // 2, least)
            _power(entry, w, idf, g, z)
        if z.any():
            for k in range(0, len(z), 256):
                yield pa.RecordBatch.from_arrays([pa.array([k // 256], pa.int32()), pa.array([z[k : k + 256].tobytes()], pa.binary())], ["piece", "z"])

    return run


def _leading(y: np.ndarray, g: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading singular values and right singular vectors of A from Y = A'(A G): A'A is nearly Y (G'Y)^-1 Y', whose factor's SVD is small."""
    shift = 1e-7 * np.sqrt(len(y)) * max(np.linalg.norm(y), 1e-30)  # a small multiple of the identity keeps the factorisation stable
    y = y + shift * g
    core = g.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 0) * 1e-12
    factor = y @ (vectors[:, good] / np.sqrt(values[good]))
    basis, singular, _ = np.linalg.svd(factor, full_matrices=False)
    values = np.maximum(singular**2 - shift, 0)
    kept = np.flatnonzero(values > values[0] * 1e-9)[:rank] if len(values) and values[0] > 0 else np.empty(0, int)
    return np.sqrt(values[kept]), basis[:, kept]


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(z, np.float32).astype(np.float64)
            total[piece] = total[piece] + x if piece in total else x
    for piece, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "z"])


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - bin(row).count("1")


class Item:
    """What the word-by-word check needs of a benchmark item: ``words`` by number, ``live`` the columns of those with weight."""

    def __init__(self, words: list[int], live: dict[int, int], near: float):
        self.words = words
        self.content = [w for w in words if w in live]
        self.answer = [w for w in words[-max(1, len(words) // 3) :] if w in live]
        self.ids = {live[w] for w in self.content}
        #: distinct content words that any verdict of a leak needs at least
        self.least = min(len(self.ids) - (1 - near) * len(words), 0.6 * len(self.content) - (len(self.content) - len(self.ids)))

    def verdict(self, region: list[int], near: float, para: float) -> tuple[float, float, bool]:
        """(share of the item's words in the common subsequence, share of its answer's content words, leaked)."""
        lcs = common_subsequence(self.words, region) / len(self.words)
        there = set(region)
        answer = sum(w in there for w in self.answer) / len(self.answer) if self.answer else lcs
        content = sum(w in there for w in self.content) / len(self.content) if self.content else lcs
        return lcs, answer, lcs >= near or lcs >= para and content >= 0.6 and answer >= 0.6


def _near(b: _Batch, space, items: list, window: int, least: int, cosine: float) -> dict[tuple, float]:
    """Candidates {(doc, item number, first and last word): cosine}: near in the latent space and with enough of the item's words."""
    renumber, project, passages, owner = space
    hit_doc, hit_pos, hit_word = b.live(renumber)
    entry, word, doc, at = _windows(hit_doc, hit_pos, hit_word, window // 2, least)
    out: dict[tuple, float] = {}
    if not len(doc):
        return out
    order = np.argsort(entry, kind="stable")
    entry, word = entry[order], word[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(entry)) + 1])
    x = np.add.reduceat(project[word], first)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    place = hit_doc << 32 | hit_pos
    for start in range(0, len(x), 4096):
        sim = x[start : start + 4096] @ passages.T
        row, col = np.nonzero(sim >= cosine)
        for r, c, s in zip((row + start).tolist(), col.tolist(), sim[row, col].tolist()):
            d, i, lo = int(doc[r]), int(owner[c]), int(at[r])
            item = items[i][1]
            lo, hi = max(0, lo - len(item.words)), lo + window + len(item.words)
            k, m = np.searchsorted(place, [d << 32 | lo, d << 32 | hi])
            if len(item.ids.intersection(hit_word[k:m].tolist())) >= item.least:
                out[d, i, lo, hi] = max(s, out.get((d, i, lo, hi), 0.0))
    return out


def _leaks(model, window: int, least: int, cosine: float, near: float, para: float, kind: str):
    """(id, item, lcs, answer, cosine, word) of the leaks among the candidates, found and checked a batch of documents at a time."""

    def run(batches):
        space, grams, items = model.value
        for part, b in _parts(batches, kind):
            asked = _near(b, space, items, window, least, cosine) if space else {}
            doc, pos, gram = b.grams(grams)
            edges = np.flatnonzero(np.diff(doc)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(doc))):
                for i, first, last in grams.stretches(pos[lo:hi], gram[lo:hi]) if hi > lo else ():
                    asked.setdefault((int(doc[lo]), i, first, last), 0.0)
            best: dict[tuple, tuple] = {}
            for (d, i, first, last), s in asked.items():
                lcs, answer, leaked = items[i][1].verdict(b.region(d, first, last), near, para)
                if leaked and ((d, i) not in best or (lcs, s, -first) > best[d, i][:3]):
                    best[d, i] = (lcs, s, -first, answer)
            if best:
                ids = part.column(0).take(pa.array([d for d, _ in best]))
                lcs, s, word, answer = (pa.array(x) for x in zip(*best.values()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items[i][0] for _, i in best], pa.int64()), lcs, answer, s.cast(pa.float64()), pa.array([-w.as_py() for w in word], pa.int64())],
                    ["id", "item", "lcs", "answer", "cosine", "word"],
                )

    return run


HITS_SQL = "id long, item long, lcs double, answer double, cosine double, word long"


def _poor(telling: int, words: int) -> bool:
    """Whether an item of so many distinct words has too few telling ones among them to be found by those alone."""
    return telling < max(min(5, words), words / 5)


def _one_block(sequences: DataFrame, kind: str, items: list, df: np.ndarray, docs: int, window, rank, over, cosine, near, para, common, least, seed) -> DataFrame:
    """Leaks of the items (number, their words' numbers) among the sequences; ``df``: document frequencies by word number."""
    spark = sequences.sparkSession
    first: dict[tuple, int] = {}
    for i, w in items:
        first.setdefault(tuple(w), i)
    alike = [(i, first[tuple(w)]) for i, w in items]  # items of the same words are checked once
    words = [(i, list(w)) for w, i in first.items()]
    shared = Counter(x for _, w in words for x in set(w))
    often = max(0.03 * len(words), 5)  # a word of so many items can't tell them apart
    few = {x for x, n in shared.items() if n <= often}
    few |= {x for w in [set(w) for _, w in words] if _poor(len(w & few), len(w)) for x in w}
    usual = {x for x in few if df[x] > max(common * docs, 20)}
    for w in [set(w) for _, w in words]:
        if _poor(len((w & few) - usual), len(w)):
            usual -= {x for x in w if shared[x] <= often}  # a word common on both sides tells nothing
    live = {x: k for k, x in enumerate(sorted(few - usual))}
    renumber = np.full(len(df), -1, np.int32)
    renumber[list(live)] = list(live.values())
    idf = (np.log((docs + 1) / (df[list(live)] + 1)) + 0.1).astype(np.float32)
    half = window // 2
    entry, word, owner = [], [], []
    for i, (_, w) in enumerate(words):
        for start in range(0, max(1, len(w) - half), half):
            part = [live[x] for x in w[start : start + window] if x in live]
            if part:
                entry += [len(owner)] * len(part)
                word += part
                owner.append(i)
    checked = [(i, Item(w, live, near)) for i, w in words]
    space = None
    if owner:
        entry, word, owner = np.array(entry), np.array(word), np.array(owner)
        width = min(rank + over, len(idf))
        least = min(least, int(np.bincount(entry).min()))
        model = spark.sparkContext.broadcast((renumber, idf, width, seed))
        pieces = sequences.mapInArrow(_sketch(model, window, least, kind), "piece int, z binary").repartition(parallelism(spark), "piece").mapInArrow(_summed, "piece int, z binary").collect()
        model.destroy()
        g = _gaussian(len(idf), width, seed)
        y = np.zeros((len(idf), width), np.float32)
        _power(entry, word, idf, g, y)  # the benchmark's own passages
        y = y.astype(np.float64)
        for p in pieces:
            x = np.frombuffer(bytes(p["z"]), np.float64).reshape(-1, width)
            y[p["piece"] * 256 : p["piece"] * 256 + len(x)] += x
        _, basis = _leading(y, g.astype(np.float64), rank)
        project = (idf[:, None] * basis).astype(np.float32)
        passages = np.add.reduceat(project[word], np.concatenate([[0], np.flatnonzero(np.diff(entry)) + 1]))
        passages /= np.maximum(np.sqrt((passages * passages).sum(1, keepdims=True)), 1e-9)
        space = (renumber, project, passages.astype(np.float32), owner)
    found = spark.sparkContext.broadcast((space, _Grams([np.array(w) for _, w in words]), checked))
    hits = sequences.mapInArrow(_leaks(found, window, least, cosine, near, para, kind), HITS_SQL)
    more = [(a, i) for i, a in alike if i != a]
    if not more:
        return hits
    each = spark.createDataFrame(more + [(i, i) for i, _ in words], "of long, each long")
    return hits.join(F.broadcast(each), F.col("item") == F.col("of")).withColumn("item", F.col("each")).drop("of", "each")


def _vocabularies(items, block_items: int, max_words: int, max_blocks: int):
    """Groups of at most so many blocks of (number, words) that have ``max_words`` words together at most, each with its vocabulary."""
    group, vocabulary = [], {}
    while block := list(islice(items, block_items)):
        block = [(i, w) for i, w in block if w]
        new = {x for _, w in block for x in w}
        if len(new) > max_words:
            raise ValueError(f"a block of the benchmark has {len(new)} words; lower block_items")
        if group and (len(group) == max_blocks or len(new | vocabulary.keys()) > max_words):
            yield group, vocabulary
            group, vocabulary = [], {}
        for x in sorted(new - vocabulary.keys()):
            vocabulary[x] = len(vocabulary) + EMPTY + 1
        if block:
            group.append([(i, [vocabulary[x] for x in w]) for i, w in block])
    if group:
        yield group, vocabulary


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 32, rank: int = 128, over: int = 10, cosine: float = 0.35, near: float = 0.7, para: float = 0.5, common: float = 0.02, least: int = 3,
    block_items: int = 2000, max_words: int = 1_000_000, max_blocks: int = 100, seed: int = 5,
) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine, word) for each document and benchmark item that it leaks; ``word`` is
    where the checked stretch begins. The driver holds ``block_items`` x ``max_blocks`` items at most, and no document."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    # a row for each text, numbered; its ids are joined in at the end
    numbers = written(named.select("text").distinct().select(F.monotonically_increasing_id().alias("item"), "text"), "d10-items")
    items = ((r["item"], plain_words(r["text"])) for r in numbers.toLocalIterator())
    total = texts.count()
    out = spark.createDataFrame([], HITS_SQL)
    for group, vocabulary in _vocabularies(items, block_items, max_words, max_blocks) if total else ():
        kind = "<u2" if len(vocabulary) < (1 << 16) - 2 else "<u4"
        known = spark.sparkContext.broadcast(vocabulary)
        sequences = written(texts.where("id is not null").mapInArrow(_sequences(known, kind), "id long, words binary"), "d10-sequences", compression="zstd")
        known.destroy()
        size = len(vocabulary) + EMPTY + 1
        df = np.zeros(size, np.int64)
        for r in sequences.mapInArrow(_frequencies(size, kind), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
            df[r["word"]] = r["n"]  # a row for each word of the benchmark
        found = [_one_block(sequences, kind, block, df, total, window, rank, over, cosine, near, para, common, least, seed) for block in group]
        found = written(reduce(DataFrame.unionByName, found), "d10-hits")
        forget(sequences)
        out = out.unionByName(found)
    ids = numbers.select(F.col("item").alias("number"), "text").join(named, "text").select("number", "item")
    out = out.withColumnRenamed("item", "number").join(ids, "number")
    best = out.groupBy("id", "item").agg(F.max(F.struct("lcs", "answer", "cosine", (-F.col("word")).alias("w"))).alias("x"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "x.lcs", "x.answer", "x.cosine", (-F.col("x.w")).alias("word")
    )


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
