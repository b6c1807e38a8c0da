"""A compacted de Bruijn graph from reads, in DataFrames.

Reads are cut where the minimizer of their overlaps (k - 1 bases) changes. All k-mers that hold an overlap meet where its minimizer is, are counted there (probes with a weight, so they survive
cutoffs), and where one k-mer ends and one begins with it, these two are linked; what is linked within a task leaves it as one piece. A k-mer whose two overlaps have different minimizers is in both places, and
the two pieces that end with it are linked by it. Linked pieces are ranked as lists by doubling pointers and joined by blocks of ranks, so no stretch is one task's work before its text is.
Minimizers with very many stretches are dealt over several tasks by the overlap. Stretches that the coverage cutoff leaves are linked again as a whole, by their ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import longkmers as lk
from strandflow.functions.sequence import revcomp
from strandflow.lineage import bounded, global_rank, written
from strandflow.operators.graph import AssemblyGraph
from strandflow.operators.superkmers import HOT, MINIMIZER, cut_bases, in_pieces, joined_bases, once, unfolded, weights_at
from strandflow.ranking import list_ranks


_RUNS = "minimizer long, salt long, flags int, size int, bases binary, n long"


def _spans(owner: np.ndarray, most: int):
    """(owner, first k-mer, behind its last, flags) for the runs of equal owners of consecutive overlaps, in at most so many k-mers. Flag 1: the first k-mer's left overlap is another's; 2: the last one's right overlap."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    stops = np.append(starts[1:], len(owner))
    for i, j, value in zip(starts.tolist(), stops.tolist(), owner[starts].tolist()):
        lo, hi = max(i - 1, 0), min(j, len(owner) - 1)
        for a in range(lo, hi, most):
            b = min(a + most, hi)
            yield value, a, b, (a < i) + 2 * (b == j)


def _run_rows(held: dict) -> pa.RecordBatch:
    size, bases = joined_bases([s for *_, s in held])
    value, salt, flags = (pa.array([x[i] for x in held], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32())))
    return pa.RecordBatch.from_arrays([value, salt, flags, size, bases, pa.array(list(held.values()), pa.int64())], ["minimizer", "salt", "flags", "size", "bases", "n"])


def _collected(found, most: int):
    """Batches of (key, weight) pairs, equal keys of so many bases together."""
    held, count = {}, 0
    for key, weight in found:
        held[key] = held.get(key, 0) + weight
        count += len(key[-1])
        if count >= most:
            yield _run_rows(held)
            held, count = {}, 0
    if held:
        yield _run_rows(held)


def _runs(k: int, m: int, most: int = 256, bases: int = 1 << 18):
    """Stretches of (seq, weight) rows by the minimizer of their overlaps, with flags as ``_spans`` gives them."""

    def out(texts: list, weights: list):
        codes = lk.codes_of(b"\n".join(texts))
        if len(codes) < k:
            return
        bad = np.concatenate([[0], np.cumsum(codes > 3)])
        pure = np.concatenate([[False], bad[k - 1 :] == bad[: 1 - k], [False]])  # of overlaps, shifted by one
        owner = lk.minimizers(codes & 3, k - 1, m)
        turn = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
        here = pure[1:-1]
        i = np.flatnonzero(here & (turn[:-1] | ~pure[:-2]))
        j = np.flatnonzero(here & (turn[1:] | ~pure[2:])) + 1
        lo, hi = i - pure[i], j - ~pure[j + 1]
        some = hi > lo
        i, j, lo, hi = i[some], j[some], lo[some], hi[some]
        if not len(i):
            return
        parts = -(-(hi - lo) // most)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        a = lo.repeat(parts) + step
        b = np.minimum(a + most, hi.repeat(parts))
        flags, size = (a < i.repeat(parts)) + 2 * (b == j.repeat(parts)), b - a + k - 1
        data = cut_bases(codes, a, size)
        order, new = once(4 * size + flags, data)
        cuts = np.flatnonzero(new)
        at = order[cuts]
        n = np.add.reduceat(weights_at(texts, weights, a)[order], cuts)
        columns = [pa.array(owner[i].astype(np.int64).repeat(parts)[at]), pa.array(np.zeros(len(at), np.int64)), pa.array(flags[at].astype(np.int32)), pa.array(size[at].astype(np.int32)), data.take(pa.array(at)), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["minimizer", "salt", "flags", "size", "bases", "n"])

    return in_pieces(out, k, bases)


def _keys(codes: np.ndarray) -> np.ndarray:
    """Numbers (or bytes, beyond 31 bases) that order as the texts of (n, k) codes do."""
    n, k = codes.shape
    if k > 31:
        return (np.ascontiguousarray(lk.packed(codes)) if n else np.zeros((0, lk.width(k)), np.uint8)).view(f"S{lk.width(k)}").ravel()
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out << 2 | codes[:, j]
    return out


def _dealt(k: int, most: int = 256):
    """Stretches of busy minimizers (minimizer, parts, flags, size, bases, n), cut again where the part changes that a hash of the overlap deals it to."""

    def found(batches):
        for batch in batches:
            for value, parts, flags, size, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                codes = lk.unpacked(np.frombuffer(data, np.uint8).reshape(-1, 1), 4).ravel()[:size]
                over = codes[np.arange(size - k + 2)[:, None] + np.arange(k - 1)]
                here, there = lk.packed(over), lk.packed(lk.turned(over))
                mixed = np.zeros(len(over), np.uint64)
                for x in np.where(lk.smaller(here, there)[:, None], here, there).T.astype(np.uint64):
                    mixed = (mixed ^ x) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                salt = (mixed % np.uint64(parts)).astype(np.int64)
                if flags & 1:
                    salt[0] = -1
                if flags & 2:
                    salt[-1] = -1
                for s, i, j, f in _spans(salt, most):
                    if s >= 0:
                        yield (value, s, f, codes[i : j + k - 1].tobytes()), n

    return lambda batches: _collected(found(batches), 1 << 20)


def _ends_in(pred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first node of each node's list and the steps from there, by doubling; nodes of rings come to no first node."""
    ptr = np.where(pred < 0, np.arange(len(pred)), pred)
    dist = (pred >= 0).astype(np.int64)
    for _ in range(len(pred).bit_length() + 1):
        if (pred[ptr] < 0).all():
            break
        dist, ptr = dist + dist[ptr], ptr[ptr]
    return ptr, dist


def _chains(codes: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, set]:
    """(node, head, pos) of canonical k-mers in the order of their lists, each list in the reading whose head is smaller, and the heads of rings. Node 2 * i is k-mer i, node 2 * i + 1 its reverse complement."""
    ids = np.arange(len(codes))
    key, ins, node = [], [], []
    for part, own, ahead in ((codes[:, 1:], foreign & 2 == 0, True), (codes[:, :-1], foreign & 1 == 0, False)):
        here, there = _keys(part[own]), _keys(lk.turned(part[own]))
        plain, back = here <= there, there <= here  # both, where the overlap is its own reverse complement
        key += [here[plain], there[back]]
        node += [2 * ids[own][plain], 2 * ids[own][back] + 1]
        ins += [np.full(plain.sum(), ahead), np.full(back.sum(), not ahead)]
    key, ins, node = np.concatenate(key), np.concatenate(ins), np.concatenate(node)
    names, at = np.unique(key, return_inverse=True)
    into, out = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    into[at[ins]], out[at[~ins]] = node[ins], node[~ins]
    good = (np.bincount(at[ins], minlength=len(names)) == 1) & (np.bincount(at[~ins], minlength=len(names)) == 1) & (into >> 1 != out >> 1)
    a, b = into[good], out[good]
    pred = np.full(2 * len(codes), -1, np.int64)
    pred[b], pred[a ^ 1] = a, b ^ 1
    head, pos = _ends_in(pred)
    rings = set()
    if (left := np.flatnonzero(pred[head] >= 0)).size:
        seen = np.zeros(len(pred), bool)
        for x in left.tolist():
            if seen[x]:
                continue
            rings.add(x)
            y, last = x, pred[x]
            while not seen[y]:
                seen[y] = seen[y ^ 1] = True
                y = pred[y]
            pred[x], pred[last ^ 1] = -1, -1
        head, pos = _ends_in(pred)
    kept = np.where(head[::2] <= head[1::2], 2 * ids, 2 * ids + 1)
    order = np.lexsort((pos[kept], head[kept]))
    kept = kept[order]
    return kept, head[kept], pos[kept], rings


def _local(k: int, cells: int):
    """Counted k-mers of stretches that come by (minimizer, salt), and what is linked among those of a batch, as pieces."""

    def out(rows: list) -> pa.RecordBatch:
        flags, sizes, data, ns = zip(*rows)
        fwd, per = unfolded(sizes, data, k)
        ends = np.cumsum(per)
        flags, f = np.array(flags), np.zeros(len(fwd), np.int64)
        f[ends - per] |= flags & 1
        f[ends - 1] |= flags & 2
        here, there = _keys(fwd), _keys(lk.turned(fwd))
        plain = here <= there
        f = np.where(plain, f, f >> 1 | (f & 1) << 1)
        keys, first, at = np.unique(np.where(plain, here, there), return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.repeat(np.array(ns, np.int64), per))
        left, right = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        left[at[f == 1]] = right[at[f == 2]] = True
        total = np.where(left & right, total // 2, total)  # from both of its places: nothing of it is another's here
        foreign = np.where(left & right, 0, left + 2 * right)
        codes = np.where(plain[first][:, None], fwd[first], lk.turned(fwd[first]))
        node, head, _, rings = _chains(codes, foreign)
        cuts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        stops = np.append(cuts[1:], len(node))
        last = np.where(node & 1, 3 - codes[node >> 1, 0], codes[node >> 1, -1])
        text = lk.texts(last[None])[0]
        begin, end = node[cuts], node[stops - 1]
        firsts = lk.texts(np.where((begin & 1)[:, None] == 1, lk.turned(codes[begin >> 1]), codes[begin >> 1]))
        seqs = [w + text[i + 1 : j] for w, i, j in zip(firsts, cuts.tolist(), stops.tolist())]
        name = lambda x: lk.binary(lk.packed(codes[x >> 1]))
        open_ = lambda x, side: pa.array((foreign[x >> 1] & np.where(x & 1, 3 - side, side)) > 0)
        none = pa.scalar(None, pa.binary())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seqs, pa.string()), pa.array(np.add.reduceat(total[node >> 1], cuts)), pa.array(total[begin >> 1]), pa.array(total[end >> 1]), pc.if_else(open_(begin, 1), name(begin), none),
                pa.array(begin & 1 == 1), pc.if_else(open_(end, 2), name(end), none), pa.array(end & 1 == 1), pa.array([x in rings for x in head[cuts].tolist()], pa.bool_()),
            ],
            ["seq", "n", "n_first", "n_last", "left", "left_turned", "right", "right_turned", "ring"],
        )

    def run(batches):
        rows, now, count = [], None, 0
        for batch in batches:
            for value, salt, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (value, salt) != now:
                    if count >= cells:
                        yield out(rows)
                        rows, count = [], 0
                    now = value, salt
                rows.append(row)
                count += (row[1] - k + 1) * k
        if rows:
            yield out(rows)

    return run


def _pieces(rows: DataFrame, k: int, m: int, hot: int, cells: int) -> DataFrame:
    """Pieces of unforked stretches of the k-mers of (seq, w): their text, counts, and the k-mers at ends that go on in another piece."""
    m = min(m, k - 1)
    cut = written(rows.select("seq", F.col("w").cast("long").alias("w")).mapInArrow(_runs(k, m), _RUNS), "build-runs")
    busy = written(cut.groupBy("minimizer").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("minimizer", F.ceil(F.col("c") / hot).alias("parts")), "build-hot")
    if busy.limit(1).count():
        busy = F.broadcast(busy) if bounded(busy, 100_000) else busy
        again = cut.join(busy, "minimizer").select("minimizer", "parts", "flags", "size", "bases", "n").mapInArrow(_dealt(k), _RUNS)
        cut = cut.join(busy, "minimizer", "left_anti").unionByName(again)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.select("minimizer", "salt", "flags", "size", "bases", "n").repartition(parts, "minimizer", "salt").sortWithinPartitions("minimizer", "salt")
    shape = "seq string, n long, n_first long, n_last long, `left` binary, left_turned boolean, `right` binary, right_turned boolean, ring boolean"
    return written(cut.mapInArrow(_local(k, cells), shape).withColumn("id", F.monotonically_increasing_id()), "build-pieces")


def _ring_texts(k: int):
    """Rings (seq, cov_sum) from their smallest k-mer on, in the direction of the smaller text."""

    def run(batches):
        for batch in batches:
            seqs = []
            for seq in batch.column(0).to_pylist():
                codes = lk.codes_of(seq.encode())
                n = len(codes) - k + 1
                words = codes[np.arange(n)[:, None] + np.arange(k)]
                here, there = _keys(words), _keys(lk.turned(words))
                at = int(np.where(here <= there, here, there).argmin())
                if here[at] > there[at]:
                    codes, at = 3 - codes[::-1], n - 1 - at
                ring = codes[(at + np.arange(n + k - 1)) % n]
                seqs.append(min(lk.texts(ring[None])[0], lk.texts(lk.turned(ring[None]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), batch.column(1)], ["seq", "cov_sum"])

    return run


def _unit_ends(units: DataFrame, k: int) -> DataFrame:
    """The same of whole sequences (id, seq)."""
    both = units.select((2 * F.col("id")).alias("node"), "seq").unionByName(units.select((2 * F.col("id") + 1).alias("node"), revcomp(F.col("seq")).alias("seq")))
    sides = F.array(F.struct(F.expr(f"right(seq, {k - 1})").alias("overlap"), F.lit(True).alias("ahead")), F.struct(F.expr(f"left(seq, {k - 1})").alias("overlap"), F.lit(False).alias("ahead")))
    return both.select("node", F.explode(sides).alias("s")).select("s.overlap", "node", "s.ahead")


def _placed(links: DataFrame, tag: str) -> DataFrame:
    """(id, head, pos, node, circular): for what is linked, the list it is on, in the reading whose head is smaller, and which way round it lies there."""
    ranks = list_ranks(links, tag)
    of = ranks.groupBy(F.shiftright("node", 1).alias("id")).agg(F.min(F.struct("head", "pos", "node", "circular")).alias("r"))
    return of.select("id", "r.*")


def _met(ends: DataFrame, tag: str) -> DataFrame:
    """(a, b): links where one node alone ends and one alone begins with an overlap."""
    met = ends.groupBy("overlap").agg(
        F.count_if("ahead").alias("ins"), F.count_if(~F.col("ahead")).alias("outs"), F.min(F.when(F.col("ahead"), F.col("node"))).alias("a"), F.min(F.when(~F.col("ahead"), F.col("node"))).alias("b")
    )
    return written(met.where("ins = 1 and outs = 1").select("a", "b").where(F.shiftright("a", 1) != F.shiftright("b", 1)), f"{tag}-links")


def _whole(pieces: DataFrame) -> DataFrame:
    """(seq, cov_sum): the parts of each list in order, read in the direction of the smaller text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    rows = pieces.groupBy("head").agg(text.alias("seq"), F.sum("n").alias("cov_sum"))
    return rows.select(F.least("seq", revcomp(F.col("seq"))).alias("seq"), "cov_sum")


def compacted(rows: DataFrame, k: int, m: int = MINIMIZER, hot: int = HOT, cells: int = 1 << 22, block: int = 4096) -> DataFrame:
    """(seq, cov_sum): maximal unambiguous stretches of the k-mers of (seq, w). ``hot``: stretches of a minimizer above which it is dealt over several tasks."""
    pieces = _pieces(rows, k, m, hot, cells)
    # two pieces share a k-mer: one ends with it as it is, one begins so
    side = lambda at, ends: F.struct(F.col(at).alias("kmer"), (F.col("id") * 2 + F.col(f"{at}_turned").cast("int")).alias("node"), ends.alias("ends"))
    shared = pieces.select(F.explode(F.array(side("right", ~F.col("right_turned")), side("left", F.col("left_turned")))).alias("s")).select("s.*").where("kmer is not null")
    met = shared.groupBy("kmer").agg(F.min(F.when(F.col("ends"), F.col("node"))).alias("a"), F.min(F.when(~F.col("ends"), F.col("node"))).alias("b"))
    twin = lambda x: F.col(x).bitwiseXOR(F.lit(1).cast("long"))
    links = met.select(F.explode(F.array(F.struct("a", "b"), F.struct(twin("b").alias("a"), twin("a").alias("b")))).alias("l")).select("l.*")
    placed = _placed(written(links, "build-links"), "build")
    rows = pieces.select("id", "seq", "n", "n_first", "n_last", "ring").join(placed, "id", "left")
    turned, on = F.coalesce(F.col("node") % 2 == 1, F.lit(False)), F.coalesce(F.col("pos") > 0, F.lit(False))
    circular = F.coalesce("circular", F.lit(False))
    # what comes before has a piece's first k-mer; a ring's first piece has it from the last one
    rows = rows.select(
        F.coalesce("head", F.col("id") * 2).alias("head"), F.coalesce("pos", F.lit(0).cast("long")).alias("pos"), F.when(turned, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), on.alias("on"),
        (F.col("n") - F.when(on | circular, F.when(turned, F.col("n_last")).otherwise(F.col("n_first"))).otherwise(0)).alias("n"), circular.alias("circular"), "ring",
    )
    rows = rows.select("head", "pos", F.when(F.col("on"), F.expr(f"substr(seq, {k + 1})")).otherwise(F.col("seq")).alias("part"), "n", "circular", "ring")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    rows = rows.groupBy("head", F.floor(F.col("pos") / block).alias("_block")).agg(F.min("pos").alias("pos"), joined.alias("part"), F.sum("n").alias("n"), F.max("circular").alias("circular"), F.max("ring").alias("ring"))
    whole = rows.groupBy("head").agg(joined.alias("seq"), F.sum("n").alias("cov_sum"), F.max("circular").alias("circular"), F.max("ring").alias("ring"))
    whole = written(whole.select(F.when(F.col("circular"), F.expr("left(seq, length(seq) - 1)")).otherwise(F.col("seq")).alias("seq"), "cov_sum", (F.col("circular") | F.col("ring")).alias("ring")), "build-stretches")
    rings = whole.where("ring").select("seq", "cov_sum").mapInArrow(_ring_texts(k), "seq string, cov_sum long")
    return whole.where("not ring").select(F.least("seq", revcomp(F.col("seq"))).alias("seq"), "cov_sum").unionByName(rings)


def merged(units: DataFrame, k: int) -> DataFrame:
    """(seq, cov_sum): the sequences (seq, cov_sum) joined where two of them alone meet."""
    ranked = written(global_rank(units, ["seq"], "merge-sorted", "id"), "merge-units")
    placed = _placed(_met(_unit_ends(ranked, k), "merge"), "merge")
    rows = ranked.join(placed, "id", "left").withColumn("pos", F.coalesce("pos", F.lit(0).cast("long")))
    read = F.when(F.col("node") % 2 == 1, revcomp(F.col("seq"))).otherwise(F.col("seq"))
    part = F.when(F.col("pos") == 0, read).otherwise(F.expr(f"substr(_read, {k})"))
    return _whole(rows.withColumn("_read", read).select(F.coalesce("head", F.col("id") * 2).alias("head"), "pos", part.alias("part"), F.col("cov_sum").alias("n")))


def _positions(k: int, bases: int = 1 << 16):
    def run(batches):
        for batch in batches:
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                codes = lk.codes_of((text or "").encode())
                edges = np.flatnonzero(np.diff(codes < 4, prepend=False, append=False))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    for lo in range(a, b - k + 1, bases):
                        at = np.arange(lo, min(lo + bases, b - k + 1))
                        fwd = codes[at[:, None] + np.arange(k)]
                        here, there = lk.packed(fwd), lk.packed(lk.turned(fwd))
                        plain = lk.smaller(here, there)
                        kept = batch.slice(row, 1).select(range(batch.num_columns - 1)).take(pa.array(np.zeros(len(at), np.int64)))
                        new = [pa.array(at.astype(np.int32)), lk.binary(np.where(plain[:, None], here, there)), pa.array(plain)]
                        yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, "pos", "kmer", "plain"])

    return run


def kmer_positions(seqs: DataFrame, k: int, seq: str, *keep: str) -> DataFrame:
    """(keep..., pos, kmer, plain): every k-mer of A, C, G and T, canonical and packed, with its place and whether it is read as it stands there."""
    rows = seqs.select(*keep, seq)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_positions(k), f"{kept}pos int, kmer binary, plain boolean")


def build_graph(reads: DataFrame, k: int = 51, coverage_cutoff: float = 0.0, probes: DataFrame | None = None, probe_weight: int = 50, track_reads: bool = True) -> AssemblyGraph:
    """The graph of reads (read_id, seq). ``k`` must be odd, and 255 at most. Probes (read_id, seq) count ``probe_weight`` times. Nodes whose coverage is below the cutoff are
    dropped and what is left is joined where it can be."""
    if k % 2 == 0:
        raise ValueError("k must be odd: a k-mer must not be its own reverse complement")
    rows = reads.select("read_id", F.upper("seq").alias("seq"), F.lit(1).alias("w"))
    if probes is not None:
        rows = probes.select("read_id", F.upper("seq").alias("seq"), F.lit(probe_weight).alias("w")).unionByName(rows)
    units = compacted(rows, k)
    if coverage_cutoff > 0:
        units = merged(written(units.where(F.col("cov_sum") / (F.length("seq") - k + 1) >= coverage_cutoff), "build-kept"), k)
    units = global_rank(units, ["seq"], "build-rank").withColumn("node_id", (F.col("rank") + 1).cast("int")).drop("rank")
    units = written(units, "build-units")
    nodes = units.select(
        "node_id", (F.length("seq") - k + 1).cast("int").alias("length"), "cov_sum", F.expr(f"substr(seq, {k})").alias("ends_fwd"),
        revcomp(F.expr(f"left(seq, length(seq) - {k - 1})")).alias("ends_twin"),
    )
    both = units.select(F.col("node_id").alias("node"), "seq").unionByName(units.select((-F.col("node_id")).alias("node"), revcomp(F.col("seq")).alias("seq")))
    left = both.select(F.col("node").alias("dst"), F.expr(f"left(seq, {k - 1})").alias("o"))
    right = both.select(F.col("node").alias("src"), F.expr(f"right(seq, {k - 1})").alias("o"))
    here, twin = F.struct("src", "dst"), F.struct((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))
    steps = right.select("src", "o").join(left, "o").select(F.greatest(here, twin).alias("e")).select("e.*").distinct()  # one of each step and its twin
    arcs = steps.select(F.abs("src").alias("begin_id"), (F.col("src") > 0).alias("begin_fwd"), F.abs("dst").alias("end_id"), (F.col("dst") > 0).alias("end_fwd"), F.lit(1).cast("long").alias("mult"))
    placed = None
    if track_reads:
        where = kmer_positions(units.withColumn("n", F.length("seq")), k, "seq", "node_id", "n").withColumnsRenamed({"pos": "at", "plain": "_plain"})
        hits = kmer_positions(rows, k, "seq", "read_id").join(where, "kmer")
        fwd = F.col("plain") == F.col("_plain")
        hits = hits.select("read_id", "node_id", fwd.alias("fwd"), F.col("pos").alias("start_coord"), F.when(fwd, F.col("at")).otherwise(F.col("n") - k - F.col("at")).alias("offset"))
        first = hits.groupBy("read_id", "node_id", "fwd").agg(F.min(F.struct("start_coord", "offset")).alias("b"))
        placed = first.select("node_id", "read_id", F.col("b.offset").cast("int").alias("offset"), F.col("b.start_coord").cast("int").alias("start_coord"), "fwd")
    return AssemblyGraph(nodes, arcs, k, placed, rows.select("read_id", "seq"), units.select("node_id", "seq"))
