"""Assembly relations bound to the benchmark's star schema: the same definitions as DataFrames and as SQL.

Texts become sequences (letters to bases), parts become graph nodes, consecutive line items of an order become arcs, events become
read placements whose mates are neighbouring ids, suppliers become connections. A second graph has a node for each order: the orders of a customer
follow each other by date, and their priorities and states add forks, steps back, loops, turns and rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.lineage import dealt

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYCLE = ("ACGT" * 7)[:26]
HEX, HEX_BASES = "0123456789abcdef", "ACGTACGTACGTACGT"

DNA_SQL = f"dna AS (SELECT doc_id, lang, source, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{UPPER}', '{CYCLE}') AS seq FROM documents)"
SCAF_SQL = f"""scaf AS (SELECT * FROM (SELECT doc_id, regexp_replace(translate(text, '{UPPER}{UPPER.lower()}', '{CYCLE}{CYCLE}'), '[^ACGT]', 'N', 'g') AS seq FROM documents) WHERE contains(seq, 'A') OR contains(seq, 'C') OR contains(seq, 'G') OR contains(seq, 'T'))"""
CONTIG_SQL = SCAF_SQL + """,
runs AS (SELECT doc_id, length(seq) AS n, unnest(regexp_extract_all(seq, 'N+|[^N]+')) AS run, unnest(range(1, len(regexp_extract_all(seq, 'N+|[^N]+')) + 1)) AS k FROM scaf),
placed AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM runs),
contigs AS (SELECT doc_id, n, run AS seq, CAST(stop AS BIGINT) AS stop, CAST(stop - length(run) + 1 AS BIGINT) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS contig_idx,
  count(*) OVER (PARTITION BY doc_id) AS contigs FROM placed WHERE NOT contains(run, 'N'))"""
NODES_SQL = f"""nodes AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS node_id, p_size AS length, CAST(floor(p_retailprice) AS BIGINT) AS cov_sum,
  substr(translate(md5(CAST(p_partkey AS VARCHAR)) || md5('x' || CAST(p_partkey AS VARCHAR)), '{HEX}', '{HEX_BASES}'), 1, p_size) AS ends_fwd,
  substr(translate(md5('t' || CAST(p_partkey AS VARCHAR)) || md5('u' || CAST(p_partkey AS VARCHAR)), '{HEX}', '{HEX_BASES}'), 1, p_size) AS ends_twin FROM part)"""
ARCS_SQL = """steps AS (SELECT l_partkey + 1 AS b, l_returnflag <> 'R' AS bf, lead(l_partkey + 1) OVER w AS e, lead(l_returnflag <> 'R') OVER w AS ef FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
arcs AS (SELECT b AS begin_id, bf AS begin_fwd, e AS end_id, ef AS end_fwd, count(*) AS mult FROM steps WHERE e IS NOT NULL GROUP BY ALL),
edges0 AS (SELECT CASE WHEN begin_fwd THEN begin_id ELSE -begin_id END AS src, CASE WHEN end_fwd THEN end_id ELSE -end_id END AS dst FROM arcs),
edges AS (SELECT src, dst FROM edges0 UNION SELECT -dst, -src FROM edges0)"""
PLACED_SQL = """noded_reads AS (SELECT CAST(user_id + 1 AS INTEGER) AS node_id, event_id AS read_id, CAST(event_id % 11 AS INTEGER) AS "offset", CAST(event_id % 7 AS INTEGER) AS start_coord, length(event_type) % 2 = 0 AS fwd FROM events),
pairs AS (SELECT event_id AS read_id, xor(event_id, 1) AS pair_id FROM events)"""
THREADS_SQL = f"""thread0 AS (SELECT o_custkey AS cust, CAST((o_orderkey + 1) * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS BIGINT) AS me, o_orderpriority AS p, o_orderstatus AS st, o_orderdate, o_orderkey FROM orders),
thread AS (SELECT cust, me, p, st, lead(me) OVER w AS next1, lead(me, 2) OVER w AS next2, lag(me) OVER w AS prev, first_value(me) OVER w AS head FROM thread0 WINDOW w AS (PARTITION BY cust ORDER BY o_orderdate, o_orderkey)),
edges0 AS (SELECT me AS src, next1 AS dst FROM thread UNION SELECT me, next2 FROM thread WHERE p = '1-URGENT' UNION SELECT me, prev FROM thread WHERE p = '2-HIGH' AND st = 'F' UNION SELECT me, me FROM thread WHERE p = '3-MEDIUM' AND st = 'P'
  UNION SELECT me, -next1 FROM thread WHERE p = '5-LOW' AND st = 'P' UNION SELECT me, head FROM thread WHERE next1 IS NULL AND me <> head AND p = '4-NOT SPECIFIED'),
edges AS (SELECT src, dst FROM edges0 WHERE dst IS NOT NULL UNION SELECT -dst, -src FROM edges0 WHERE dst IS NOT NULL),
starts AS (SELECT cust AS source, me AS start FROM thread WHERE prev IS NULL), stops AS (SELECT cust AS source, me AS stop FROM thread WHERE next1 IS NULL),
probes AS (SELECT 2 * source AS i, start AS s FROM starts UNION ALL SELECT 2 * source + 1, -stop FROM stops),
nodes AS (SELECT CAST(o_orderkey + 1 AS BIGINT) AS node_id, CAST(floor(o_totalprice) AS BIGINT) % 30 + 1 AS length, CAST(floor(o_totalprice) AS BIGINT) % 200 AS cov_sum FROM orders)"""
CONN_SQL = """conn0 AS (SELECT s_suppkey AS seq1, CASE WHEN s_suppkey % 3 = 0 THEN 'start' ELSE 'end' END AS side1, (s_suppkey * 37 + 11) % 97 AS seq2,
  CASE WHEN s_suppkey % 2 = 0 THEN 'start' ELSE 'end' END AS side2, s_suppkey % 50 + 1 AS distance FROM supplier),
conn1 AS (SELECT CASE WHEN (seq1, side1) <= (seq2, side2) THEN seq1 ELSE seq2 END AS a, CASE WHEN (seq1, side1) <= (seq2, side2) THEN side1 ELSE side2 END AS sa,
  CASE WHEN (seq1, side1) <= (seq2, side2) THEN seq2 ELSE seq1 END AS b, CASE WHEN (seq1, side1) <= (seq2, side2) THEN side2 ELSE side1 END AS sb, distance FROM conn0),
conn AS (SELECT a AS seq1, sa AS side1, b AS seq2, sb AS side2, min(distance) AS distance FROM conn1 GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.translate(letters, UPPER, CYCLE).alias("seq"))


def scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace(F.translate("text", UPPER + UPPER.lower(), CYCLE * 2), "[^ACGT]", "N")
    rows = table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq")).where(F.regexp_like("seq", F.lit("[ACGT]")))
    return rows.select(F.col("doc_id").alias("scaffold_idx"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "seq")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    bases = lambda a, b: F.substr(F.translate(F.concat(F.md5(a), F.md5(b)), HEX, HEX_BASES), F.lit(1), F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).cast("int").alias("node_id"), F.col("p_size").alias("length"), F.floor("p_retailprice").cast("long").alias("cov_sum"),
        bases(key, F.concat(F.lit("x"), key)).alias("ends_fwd"), bases(F.concat(F.lit("t"), key), F.concat(F.lit("u"), key)).alias("ends_twin"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(begin_id, begin_fwd, end_id, end_fwd): a row for each two consecutive line items of an order."""
    items = table(spark, sf_dir, "lineitem")
    items = dealt(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"), items.count(), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    here = (F.col("l_partkey") + 1).cast("int")
    fwd = F.col("l_returnflag") != "R"
    return items.select(here.alias("begin_id"), fwd.alias("begin_fwd"), F.lead(here).over(w).alias("end_id"), F.lead(fwd).over(w).alias("end_fwd")).where("end_id is not null")


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ["begin_id", "begin_fwd", "end_id", "end_fwd"]
    return dealt(steps(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), *ends).groupBy(*ends).agg(F.count("*").alias("mult"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, me, p, st, next1, next2, prev, head): each order as a signed node with its neighbours in the customer's order of dates."""
    me = (F.col("o_orderkey") + 1).cast("int")
    w = Window.partitionBy("cust").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust"), F.when(F.col("o_orderstatus") == "O", -me).otherwise(me).alias("me"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"), "o_orderdate", "o_orderkey"
    )
    return rows.select(
        "cust", "me", "p", "st", F.lead("me").over(w).alias("next1"), F.lead("me", 2).over(w).alias("next2"), F.lag("me").over(w).alias("prev"), F.first("me").over(w).alias("head")
    )


def thread_graph(spark: SparkSession, sf_dir: str, k: int = 31):
    """The graph of orders: steps to the next order, and by priority and state past it, back, to the same order, to the next one turned, or from the last to the first."""
    from strandflow.operators.graph import AssemblyGraph

    key, price = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("long")
    size = (price % 30 + 1).cast("int")
    bases = lambda x: F.substr(F.translate(F.md5(x), HEX, HEX_BASES), F.lit(1), size)
    nodes = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).cast("int").alias("node_id"), size.alias("length"), (price % 200).alias("cov_sum"), bases(key).alias("ends_fwd"), bases(F.concat(F.lit("t"), key)).alias("ends_twin"),
    )
    to = [
        F.col("next1"), F.when(F.col("p") == "1-URGENT", F.col("next2")), F.expr("if(p = '2-HIGH' and st = 'F', prev, null)"), F.expr("if(p = '3-MEDIUM' and st = 'P', me, null)"),
        F.expr("if(p = '5-LOW' and st = 'P', -next1, null)"), F.expr("if(next1 is null and me != head and p = '4-NOT SPECIFIED', head, null)"),
    ]
    steps = threads(spark, sf_dir).select("me", F.explode(F.array_distinct(F.array(*to))).alias("dst")).where("dst is not null")
    arcs = steps.select(F.abs("me").alias("begin_id"), (F.col("me") > 0).alias("begin_fwd"), F.abs("dst").alias("end_id"), (F.col("dst") > 0).alias("end_fwd"), F.lit(1).cast("long").alias("mult"))
    return AssemblyGraph(nodes, arcs, k)  # a customer's arcs stay in one task


def thread_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, start): each customer's first order."""
    return threads(spark, sf_dir).where("prev is null").select(F.col("cust").alias("source"), F.col("me").alias("start"))


def thread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, start, stop): the first and last order of each customer who has two or more."""
    ends = threads(spark, sf_dir).where("next1 is null and me != head")
    return ends.select(F.col("cust").alias("pair_id"), F.col("head").alias("start"), F.col("me").alias("stop"))


def thread_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe_idx, node, offset): two for each customer, at the first order forwards and at the last one turned."""
    rows = threads(spark, sf_dir).select("cust", F.explode(F.expr("filter(array(struct(0 as side, if(prev is null, me, null) as node), struct(1 as side, if(next1 is null, -me, null) as node)), x -> x.node is not null)")).alias("x"))
    return rows.select((F.col("cust") * 2 + F.col("x.side")).alias("probe_idx"), F.col("x.node").alias("node"), F.lit(0).alias("offset"))


def noded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") + 1).cast("int").alias("node_id"), F.col("event_id").alias("read_id"), (F.col("event_id") % 11).cast("int").alias("offset"),
        (F.col("event_id") % 7).cast("int").alias("start_coord"), (F.length("event_type") % 2 == 0).alias("fwd"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("read_id"), F.col("event_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.operators.scaffolds import canonical_connections

    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        key.alias("seq1"), F.when(key % 3 == 0, "start").otherwise("end").alias("side1"), ((key * 37 + 11) % 97).alias("seq2"),
        F.when(key % 2 == 0, "start").otherwise("end").alias("side2"), (key % 50 + 1).alias("distance"),
    )
    return canonical_connections(rows).groupBy("seq1", "side1", "seq2", "side2").agg(F.min("distance").alias("distance"))
