"""Exact n-gram Jaccard self-join with set-relation skipping.

Documents with equal shingle sets are one set. Each set puts its rarest shingles (a prefix) into an
inverted index; two sets with Jaccard similarity >= ``percent``/100 share a prefix shingle under any one
order of shingles, so an estimated rarity order costs candidates, never results.

Index level: every list is held in blocks by position. A pair whose first common shingle stands at
positions i and j has at most min(n-i, m-j) common shingles, so whole pairs of blocks are skipped by the
bounds in their heads.

Answer level: in a few turns each set is computed against a few partners in each list: the list's pivot and
neighbours in an order that all lists share. Sets that prove similar take over each other's answer, their
component; afterwards only candidates outside that answer are computed, all of them, and of those a
candidate u is skipped where a similar set p has the computed distance d(p, u) - d(p, s) beyond the limit
(Jaccard distance is a metric). A group of copies thus costs a few pairs for each copy, not one for each pair of
copies, and no link between components is lost. Lists that may hold more than ``hot`` sets are dealt to parts, other ones at each turn, so no
task orders a whole hot list; the last step needs no order.

Sets go by 64 bits of a 128-bit digest; sets whose 64 bits are equal get other numbers.

Defined results: null or empty texts have an empty set, link with nothing and are their own component;
repeated rows are rows of the same component; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, clustered, connected_components, forget, nameless, numbered, text_batches, written
from .shingles import shingle_set

PIECE = 1 << 16


def _log_cells(df: DataFrame) -> int:
    """Cells of the rarity sketch, from the input's size: a performance hint with bounds, 4 MB broadcast at most."""
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(22, max(16, np.ceil(np.log2(max(size, 1.0) / 256)))))


def _digest(s: np.ndarray, key_bits: int) -> tuple[int, int]:
    """A set's number and the check that tells it from others of that number."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True) >> 64 - key_bits, int.from_bytes(d[8:], "little", signed=True)


def _survey(width: int, log_cells: int, key_bits: int):
    """Per document its set's 128-bit digest and size; per task the counts of its sketch cells, in pieces."""

    def run(batches):
        cells = np.zeros(1 << log_cells, np.uint32)
        shift = np.uint64(64 - log_cells)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start in range(0, len(ids), 1000):
                sid, check, n, seen = [], [], [], []
                for t in texts.slice(start, 1000):
                    s = shingle_set(t.as_py(), width)
                    number, own = _digest(s, key_bits)
                    sid.append(number)
                    check.append(own)
                    n.append(len(s))
                    seen.append(s)
                if seen:
                    cells += np.bincount(np.concatenate(seen) >> shift, minlength=len(cells)).astype(np.uint32)
                k = len(sid)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, k), pa.array(sid, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    ["id", "sid", "check", "n", "piece", "counts"],
                )
        pieces = [i for i in range(0, len(cells), PIECE) if cells[i : i + PIECE].any()]
        for i in pieces:
            z = zlib.compress(cells[i : i + PIECE].tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i // PIECE], pa.int32()), pa.array([z], pa.binary())],
                ["id", "sid", "check", "n", "piece", "counts"],
            )

    return run


def _classes(hot: int):
    """Adds up the pieces of one partition and rates each cell: 0 for ordinary counts, then a step per doubling; and the logarithm of the
    parts that its lists are dealt to."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(z), np.uint32).astype(np.uint64)
                total[piece] = total[piece] + c if piece in total else c
        for piece, c in total.items():
            usual = max(1.0, float(np.median(c)))
            rate = np.clip(np.floor(np.log2(np.maximum(c, 1) / usual * 0.8)), 0, 60).astype(np.uint8)
            parts = np.clip(np.ceil(np.log2(np.maximum(c, 1) / hot)), 0, 20).astype(np.uint8)
            packed = [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (rate, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *packed], ["piece", "rate", "parts"])

    return run


def _prefix(width: int, percent: int, log_cells: int, key_bits: int, rates):
    """(tok, sid, n, pos, part) for the prefix of each set; a task emits a set once."""

    def run(batches):
        rate, parts, names = rates.value
        rate, parts = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (rate, parts))
        shift = np.uint64(64 - log_cells)
        done: set[int] = set()

        def flushed(tok, sid, n, part):
            lens = np.fromiter((len(t) for t in tok), np.int64, len(tok))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tok).view(np.int64)),
                    pa.array(np.repeat(np.array(sid, np.int64), lens)),
                    pa.array(np.repeat(np.array(n, np.int32), lens)),
                    pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lens])),
                    pa.array(np.concatenate(part)),
                ],
                ["tok", "sid", "n", "pos", "part"],
            )

        for batch in batches:
            tok, sids, ns, dealt, rows = [], [], [], [], 0
            for t in batch.column(0):
                s = shingle_set(t.as_py(), width)
                if not len(s):
                    continue
                number, own = _digest(s, key_bits)
                sid = names.get((number, own), number)
                if sid in done:
                    continue
                if len(done) >= 1 << 18:
                    done.clear()
                done.add(sid)
                k = len(s) - (percent * len(s) + 99) // 100 + 1
                cell = s >> shift
                order = np.argsort(rate[cell], kind="stable")[:k]
                power = parts[cell[order]].astype(np.int32)
                tok.append(s[order])
                sids.append(sid)
                ns.append(len(s))
                dealt.append(np.where(power > 0, power << 24 | (sid & 0xFFFFF) & (1 << power) - 1, 0).astype(np.int32))
                rows += k
                if rows >= 100_000:
                    yield flushed(tok, sids, ns, dealt)
                    tok, sids, ns, dealt, rows = [], [], [], [], 0
            if tok:
                yield flushed(tok, sids, ns, dealt)

    return run


def _sets_of(width: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1).slice(start, 500)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                values = np.concatenate(part) if part else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 500), pa.ListArray.from_arrays(offsets, values)], ["sid", "items"]
                )

    return run


def _need(n, m, percent: int):
    """Least overlap of sets of n and m shingles that link: o * (100 + percent) >= percent * (n + m)."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _fits(n, i, m, j, percent: int):
    """Length and position bounds of a pair whose first common shingle stands at i and j."""
    return (
        (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))
        & (F.least(n - i, m - j) >= _need(n, m, percent))
    )


def _plausible(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose prefixes have too few shingles in common: what is common beyond the prefix that ends first
    is at most the rest of its set."""
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    shared = lists.join(sids, "sid", "left_semi").groupBy("sid").agg(F.collect_set("tok").alias("t"))
    both = pairs.join(shared.select(F.col("sid").alias("a"), F.col("t").alias("t_a")), "a").join(
        shared.select(F.col("sid").alias("b"), F.col("t").alias("t_b")), "b"
    )
    beyond = F.ceil(F.lit(percent) * F.greatest("n_a", "n_b") / F.lit(100)) - 1
    enough = F.size(F.array_intersect("t_a", "t_b")) + beyond >= _need(F.col("n_a"), F.col("n_b"), percent)
    return both.where(enough).select("a", "n_a", "b", "n_b")


def _overlaps(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, most: int, tag: str) -> DataFrame:
    """Adds the exact overlap to pairs (a, n_a, b, n_b) of sets; only texts of sets in a pair are read again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid").select("sid", "id")
    wanted = written(wanted, f"{tag}-wanted")
    few = F.broadcast(wanted) if bounded(wanted, most) else wanted  # 16 bytes a row
    sets = written(
        texts.join(few, "id").select("sid", "text").mapInArrow(_sets_of(width), "sid long, items array<long>"),
        f"{tag}-sets",
    )
    with_b = pairs.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("items_b")), "b")
    both = with_b.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("items_a")), "a")
    out = written(both.select("a", "n_a", "b", "n_b", F.size(F.array_intersect("items_a", "items_b")).alias("o")), f"{tag}-judged")
    forget(wanted, sets)
    return out


def _numbers(sets: DataFrame, most: int) -> dict[tuple[int, int], int]:
    """New numbers by (sid, check) for sets (sid, check, id) that share one: about 1 in 2**64 pairs of sets do."""
    shared = sets.groupBy("sid").count().where("count > 1").select("sid")
    rows = [(r["sid"], r["check"]) for r in sets.join(shared, "sid").select("sid", "check").limit(most + 1).collect()]
    if len(rows) > most:
        raise RuntimeError("too many sets have one 64-bit digest")
    for seed in range(100 if rows else 0):
        names = {(s, c): xxhash.xxh64_intdigest(f"{s} {c}", seed) - (1 << 63) for s, c in rows}
        taken = sets.sparkSession.createDataFrame([(x,) for x in names.values()], "sid long")
        if len(set(names.values())) == len(names) and not sets.join(F.broadcast(taken), "sid", "left_semi").limit(1).count():
            return names
    if rows:
        raise RuntimeError("sets found no numbers of their own")
    return {}


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    turns: int = 4,
    broadcast_rows: int = 1_000_000,
    hot: int = 1 << 17,
    key_bits: int = 64,
) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable by links of similarity
    ``percent``/100 or more. Rows without an id link as others do and keep a null id; component_id is null where no row of the
    group has an id. ``broadcast_rows`` bounds the only id list that is ever broadcast (16 bytes a row)."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, top = numbered(texts, "id", "j9-numbered")
    log_cells = _log_cells(texts)
    survey = written(
        texts.mapInArrow(_survey(width, log_cells, key_bits), "id long, sid long, check long, n long, piece int, counts binary"), "j9-survey"
    )
    found = survey.where("piece IS NULL").select("id", "sid", "check", "n")
    reps = written(found.where("n > 0").groupBy("sid", "check").agg(F.min("id").alias("id")), "j9-reps")
    names = _numbers(reps, 100_000)
    if names:
        new = F.broadcast(spark.createDataFrame([(*k, v) for k, v in names.items()], "sid long, check long, new long"))
        renamed = lambda t: t.join(new, ["sid", "check"], "left").withColumn("sid", F.coalesce("new", "sid")).drop("new")
        found, given = renamed(found), reps
        reps = written(renamed(reps), "j9-reps")
        forget(given)
    sets = reps.select("sid", "id")

    rated = (
        clustered(survey.where("piece IS NOT NULL").select("piece", "counts"), "piece")
        .mapInArrow(_classes(hot), "piece int, rate binary, parts binary")
        .collect()
    )  # two bytes a cell before compression, 8 MB at most
    rate, parts = (np.zeros(1 << log_cells, np.uint8) for _ in range(2))
    for r in rated:
        for whole, name in ((rate, "rate"), (parts, "parts")):
            piece = np.frombuffer(zlib.decompress(bytes(r[name])), np.uint8)
            whole[r["piece"] * PIECE : r["piece"] * PIECE + len(piece)] = piece
    rates = spark.sparkContext.broadcast((*(zlib.compress(x.tobytes(), 1) for x in (rate, parts)), names))

    index = texts.select("text").mapInArrow(_prefix(width, percent, log_cells, key_bits, rates), "tok long, sid long, n int, pos int, part int")
    own = Window.partitionBy("tok", "part")
    lists = written(
        clustered(index, "tok", "part")
        .withColumn("last", F.max("sid").over(own))
        .withColumn("first", F.min("sid").over(own))
        .where("first != last or part != 0")
        .select("tok", "sid", "n", "pos", "part")
        .distinct(),
        "j9-lists",
    )
    rates.destroy()
    left = lists.withColumn("comp", F.col("sid"))
    judged, classes, old = None, None, []
    for turn in range(turns + 1):
        asked = _partners(left, turn, percent) if turn < turns else _outside(left, judged, percent)
        if judged is not None:
            asked = asked.join(judged.select("a", "b"), ["a", "b"], "left_anti")
        asked = written(asked, "j9-asked")
        likely = written(_plausible(asked, lists, percent), "j9-plausible")
        forget(asked)
        if not likely.limit(1).count():
            forget(likely)
            continue
        new = _overlaps(likely, texts, sets, width, broadcast_rows, "j9")
        forget(likely)
        old.append(new)
        judged = new if judged is None else judged.unionByName(new)
        links = new.where(F.col("o") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")
        if not links.limit(1).count():
            continue
        before = classes  # known components are stars, to which this turn's links are added
        links = links if before is None else links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        classes = written(connected_components(links, "a", "b", "j9"), "j9-classes")
        forget(before)
        if turn < turns:
            last, left = left, _mixed(left, classes, turn, hot)
            forget(last)
    forget(lists, left, *old)
    if classes is None:
        classes = spark.createDataFrame([], "node long, component long")

    # the smallest id of each set: rows meet it by set, never by component
    found_classes, classes = classes, classes.withColumnRenamed("node", "sid")
    smallest = written(sets.join(classes, "sid").groupBy("component").agg(F.min("id").alias("lowest")), "j9-smallest")
    heads = classes.join(smallest, "component").select("sid", "lowest").unionByName(sets.join(classes, "sid", "left_anti").select("sid", F.col("id").alias("lowest")))
    heads = written(heads, "j9-heads")
    forget(smallest, reps, found_classes)
    out = found.where("n > 0").join(heads, "sid").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"))
    none = found.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return nameless(out.unionByName(none), top, id_col, "component_id")


def _mixed(left: DataFrame, classes: DataFrame, turn: int, hot: int) -> DataFrame:
    """The rows of lists that hold more than one component; hot lists are dealt anew to parts."""
    named = left.drop("comp").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("comp", F.coalesce("component", "sid")).drop("component")
    several = named.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x != y").select("tok", "rows")
    part = F.pmod(F.xxhash64(F.lit("part"), F.lit(turn), "sid"), F.ceil(F.col("rows") / hot)).cast("int")
    return written(named.join(several, "tok").select("tok", "comp", "sid", "n", "pos", part.alias("part")), "j9-left")


def _partners(left: DataFrame, turn: int, percent: int) -> DataFrame:
    """A few partners from another component for each set in each list or its part: the list's pivot (its smallest set) at first,
    and the 1, 2, 4, ... sets before it in an order that is the same in all lists and another at each turn."""
    order = Window.partitionBy("tok", "part").orderBy(F.xxhash64(F.lit(turn), "sid"), "sid")
    me = F.struct("sid", "n", "pos", "comp")
    near = [F.lag(me, k).over(order) for k in range(1, (1 << turn) + 1)]
    if turn == 0:
        near.append(F.first(me).over(Window.partitionBy("tok", "part").orderBy("n", "sid")))
    rows = left.select("sid", "n", "pos", "comp", *[w.alias(f"p{i}") for i, w in enumerate(near)])
    rows = rows.withColumn("p", F.explode(F.array(*[f"p{i}" for i in range(len(near))]))).where("p.comp != comp")
    rows = rows.where(_fits(F.col("p.n"), F.col("p.pos"), F.col("n"), F.col("pos"), percent))
    return _ordered(rows.select(F.col("p.sid").alias("sid_a"), F.col("p.n").alias("n_a"), F.col("sid").alias("sid_b"), F.col("n").alias("n_b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, n_a, b, n_b) with a < b."""
    turned = F.col("sid_a") < F.col("sid_b")
    return pairs.select(
        F.least("sid_a", "sid_b").alias("a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("sid_a", "sid_b").alias("b"), F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    ).distinct()


def _outside(left: DataFrame, judged: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between different components: block heads first, then the rows of blocks that may hold one."""
    left = left.withColumn("block", F.floor(F.col("pos") * 32 / F.col("n")))
    heads = left.groupBy("tok", "comp", "block").agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest")
    )
    a, b = (heads.select("tok", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "block", "n0", "n1", "rest")]) for s in "ab")
    blocks = a.join(b, "tok").where(
        (F.col("comp_a") < F.col("comp_b"))
        & (100 * F.col("n1_a") >= percent * F.col("n0_b"))
        & (100 * F.col("n1_b") >= percent * F.col("n0_a"))
        & (F.least("rest_a", "rest_b") >= _need(F.col("n0_a"), F.col("n0_b"), percent))
    ).select("tok", "comp_a", "block_a", "comp_b", "block_b")
    ra, rb = (left.select("tok", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "block", "sid", "n", "pos")]) for s in "ab")
    pairs = _ordered(
        blocks.join(ra, ["tok", "comp_a", "block_a"])
        .join(rb, ["tok", "comp_b", "block_b"])
        .where(_fits(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent))
        .select("sid_a", "n_a", "sid_b", "n_b")
    )
    if judged is None:
        return pairs
    d = judged.select("a", "b", (1 - F.col("o") / (F.col("n_a") + F.col("n_b") - F.col("o"))).alias("d"))
    known = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    # a pivot's computed answers settle pairs of its members: d(s, u) >= d(p, u) - d(p, s)
    near = known.where(F.col("d") <= 1 - percent / 100)
    far = known.where(F.col("d") > 1 - percent / 100).select(F.col("a").alias("p"), F.col("b").alias("u"), F.col("d").alias("d_u"))
    settled = near.select(F.col("b").alias("p"), F.col("a").alias("s"), F.col("d").alias("d_s")).join(far, "p").where(
        F.col("d_u") - F.col("d_s") > 1 - percent / 100 + 1e-9
    ).select(F.least("s", "u").alias("a"), F.greatest("s", "u").alias("b")).distinct()
    return pairs.join(settled, ["a", "b"], "left_anti")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l0 AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
links AS (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
"""
