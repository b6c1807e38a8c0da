"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets. Sources, by code point with null last, weigh 1, 2, 3, repeating, and share all words; a target
   stops at ``most`` times its source's words and the excess is shared again by weight (water filling, in
   closed form over one row for each source).
2. Blocks. Each source's documents are dealt by a seeded hash into blocks of about ``block_words`` words. A
   source gives whole rounds of all its blocks, then a part of a permuted round; the last block is cut at
   a document, and one further document that fits best closes the gap.
3. Tree. The exact block quotas of the sources are split recursively among output shards: at a node with l
   shards the left child draws its share of the node's blocks without replacement, so the counts per source
   are one multivariate-hypergeometric draw (each block in turn goes left with probability
   places left / blocks left). Quotas stay exact at every node.
4. Draw. A source's permuted blocks are dealt to shards by the leaves' quotas, so shards draw disjoint
   blocks; ``key`` orders a shard's rows locally.

The number of blocks is bounded by ``most_blocks`` (blocks grow with the input), so the tree and the block
tables are small at any size; document rows meet them by (source, block), never by source alone.

Defined results: null or empty text has size 0 and is never taken; null source is a source; rows without an id, and rows that share one, are
rows of their own, told apart by source and text and, where these are equal too, by their number among their equals; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, forget, global_rank, keyed, written

WORD = r"[^\x20\x09-\x0D]+"
SHARDS = 16


def source_targets(rows: DataFrame, most: float = 3.0) -> DataFrame:
    """One row for each source: (source, source_size, weight, target)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    everything = Window.partitionBy()
    s = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
        .withColumn("open", F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level")))
        .withColumn("final", F.coalesce(F.min("open").over(everything)["level"], F.lit(0.0)))
    )
    return s.select("source", "source_size", "weight", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def _split(quotas: DataFrame, seed: str, shards: int) -> DataFrame:
    """(source, start, n, shard): each shard's stretch of the source's permuted blocks. quotas: (source_no, n)."""
    tree = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source_no", "n"))).alias("q")
    ).select(F.lit(0).alias("first"), F.lit(shards).alias("leaves"), "q")
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        drawn = f"""
          aggregate(q,
            named_struct('pop', aggregate(q, 0L, (s, x) -> s + x.n),
                         'draw', aggregate(q, 0L, (s, x) -> s + x.n) * (leaves div 2) div leaves,
                         'out', cast(array() as array<bigint>)),
            (a, x) -> named_struct(
              'pop', a.pop - x.n,
              'draw', a.draw - aggregate(if(x.n > 0, sequence(1L, x.n), cast(array() as array<bigint>)), named_struct('pop', a.pop, 'draw', a.draw),
                  (s, i) -> named_struct('pop', s.pop - 1L, 'draw', s.draw - if(pmod(xxhash64('{seed}', {level}, first, x.source_no, i), 1073741824L) / 1073741824D * s.pop < s.draw, 1L, 0L)),
                  s -> a.draw - s.draw),
              'out', array_append(a.out, aggregate(if(x.n > 0, sequence(1L, x.n), cast(array() as array<bigint>)), named_struct('pop', a.pop, 'draw', a.draw),
                  (s, i) -> named_struct('pop', s.pop - 1L, 'draw', s.draw - if(pmod(xxhash64('{seed}', {level}, first, x.source_no, i), 1073741824L) / 1073741824D * s.pop < s.draw, 1L, 0L)),
                  s -> a.draw - s.draw))),
            a -> a.out)"""
        tree = (
            tree.withColumn("left", F.when(F.col("leaves") > 1, F.expr(drawn)))
            .select(F.explode(F.expr("""
              if(leaves > 1,
                array(named_struct('first', first, 'leaves', leaves div 2, 'q', zip_with(q, left, (x, k) -> named_struct('source_no', x.source_no, 'n', k))),
                      named_struct('first', cast(first + leaves div 2 as int), 'leaves', leaves - leaves div 2, 'q', zip_with(q, left, (x, k) -> named_struct('source_no', x.source_no, 'n', x.n - k)))),
                array(named_struct('first', first, 'leaves', cast(leaves as bigint), 'q', q)))""")).alias("t"))
            .select("t.first", F.col("t.leaves").cast("int").alias("leaves"), "t.q")
        )
        tree = written(tree, f"m6-tree{level}")
    leaf = tree.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source_no", "x.n")
    before = Window.partitionBy("source_no").orderBy("shard")
    return leaf.withColumn("start", F.sum("n").over(before) - F.col("n"))


def _drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> tuple[DataFrame, Column]:
    """``docs`` and a hash that tells its rows apart and is the same however the rows lie."""
    rows, row = keyed(docs, id_col, "m6-keyed")
    if row == id_col:
        return docs, F.xxhash64(F.lit(seed), F.col(id_col))
    equal = F.sha2(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.sha2(text_col, 256).alias("t"))), 256)
    ranked = global_rank(rows.select(row, equal.alias("digest")), ["digest", row], "m6-equals")
    numbers = ranked.join(ranked.groupBy("digest").agg(F.min("rank").alias("first")), "digest")
    name = "mix"
    while name in docs.columns:
        name += "_"
    numbers = written(numbers.select(row, F.xxhash64(F.lit(seed), "digest", F.col("rank") - F.col("first")).alias(name)), "m6-numbers")
    forget(ranked)
    return rows.join(numbers, row), F.col(name)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    shards: int = SHARDS,
    most: float = 3.0,
    block_words: int = 4096,
    most_blocks: int = 1 << 16,
    seed: str = "mix",
    carry: tuple = (),
    broadcast_rows: int = 1 << 18,
) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, copies (array of (shard, key): one for
    each time the mix takes it; key orders the shard's rows) and taken (words, repeats counted); with ``carry``, a
    struct ``carried`` of the columns named there instead of id and source. ``broadcast_rows`` bounds the block table that is broadcast to
    rows that carry more; beyond it they are dealt by block."""
    docs, mix = _drawn(docs, id_col, source_col, text_col, seed)
    computed = (
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        mix.alias("mix"),
    )
    rows = written(docs.select(*computed), "m6-rows")
    targets = source_targets(rows, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    total = F.sum("source_size").over(Window.partitionBy())
    words = F.greatest(F.lit(block_words), F.ceil(total / most_blocks)).cast("long")
    targets = targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).cast("long"))
    targets = written(
        targets.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("target") - F.col("rounds") * F.col("source_size")),
        "m6-targets",
    )
    own = targets.withColumnRenamed("source", "s")
    place = lambda r, own: r.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "block", F.pmod(F.shiftrightunsigned("mix", 16), F.col("blocks"))
    )
    placed = place(rows, own)
    blocks = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("words"), F.first("rounds").alias("rounds"), F.first("part").alias("part")
    )
    permuted = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed), F.lit("round"), "source_no", "block"), "block")
    blocks = written(
        blocks.withColumn("until", F.sum("words").over(permuted))
        .withColumn("room", F.col("part") - (F.col("until") - F.col("words")))
        .withColumn("whole", F.col("until") <= F.col("part"))
        .withColumn("cut", ~F.col("whole") & (F.col("room") > 0)),
        "m6-blocks",
    )
    # the cut block of each source: a prefix of its documents by hash, and the one that then fits best
    inside = placed.join(blocks.where("cut").select("source_no", "block", "room"), ["source_no", "block"])
    by_hash = inside.groupBy("source_no", "block", "mix").agg(F.sum("size").alias("w"), F.first("room").alias("room"))
    running = Window.partitionBy("source_no").orderBy("mix")
    by_hash = by_hash.withColumn("until", F.sum("w").over(running)).withColumn("in", F.col("until") <= F.col("room"))
    gap = by_hash.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("in"), F.col("until"))).over(Window.partitionBy("source_no")), F.lit(0)))
    edge = gap.groupBy("source_no").agg(
        F.max(F.when(F.col("in"), F.col("mix"))).alias("upto"),
        F.min(F.when(~F.col("in") & (F.abs(F.col("gap") - F.col("w")) < F.col("gap")), F.struct(F.abs(F.col("gap") - F.col("w")).alias("d"), F.col("mix").alias("m"))))["m"].alias("extra"),
    )
    edge = written(edge, "m6-edge")

    # quotas in blocks, the tree, and each block's shards
    taken_blocks = blocks.select(
        "source_no", "block", F.explode(F.expr("if(rounds > 0 or whole or cut, sequence(0L, rounds - if(whole or cut, 0L, 1L)), cast(array() as array<bigint>))")).alias("round")
    )
    order = Window.partitionBy("source_no").orderBy("round", F.xxhash64(F.lit(seed), "round", "source_no", "block"), "block")
    taken_blocks = written(taken_blocks.withColumn("no", F.row_number().over(order) - 1), "m6-copies")
    leaves = _split(taken_blocks.groupBy("source_no").agg(F.count("*").alias("n")), seed, shards)
    dealt = leaves.where("n > 0").select("source_no", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("no"))
    by_block = (
        taken_blocks.join(dealt, ["source_no", "no"])
        .join(blocks.select("source_no", "block", "rounds", "cut"), ["source_no", "block"])
        .groupBy("source_no", "block")
        .agg(
            F.sort_array(F.collect_list(F.struct("round", "shard"))).alias("draws"),
            F.first("rounds").alias("full"),
            F.first("cut").alias("cut"),
        )
    )
    if carry:
        by_block = written(by_block, "m6-by-block")
        if bounded(by_block, broadcast_rows):  # and so are the tables of a row for each source
            own, by_block, edge = F.broadcast(own), F.broadcast(by_block), F.broadcast(edge)
        placed = place(docs.select(F.struct(*carry).alias("carried"), *computed), own)
    out = placed.join(by_block, ["source_no", "block"], "left").join(edge, "source_no", "left")
    in_edge = F.coalesce(F.col("mix") <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("mix") == F.col("extra"), F.lit(False))
    out = out.withColumn("_in", ~F.coalesce(F.col("cut"), F.lit(False)) | in_edge)
    out = out.withColumn(
        "copies",
        F.expr(f"""if(size > 0 and draws is not null,
            transform(filter(draws, d -> d.round < full or _in), d -> named_struct('shard', d.shard, 'key', xxhash64('{seed}', d.shard, d.round, mix))),
            cast(array() as array<struct<shard: int, key: bigint>>))"""),
    )
    named = ["carried"] if carry else [F.col("id").alias(id_col), F.col("source").alias(source_col)]
    return out.select(
        *named, "size", "source_size", "target", "copies",
        (F.col("size") * F.size("copies")).cast("long").alias("taken"),
    )
