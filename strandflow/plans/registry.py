"""Every query by name, with the SQL that must agree with it. Arrays are given as joined text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import sequence as sq
from strandflow.functions import trails as tr
from strandflow.operators import cycles as cy
from strandflow.operators import graph as gr
from strandflow.operators import kmers as km
from strandflow.operators import orfs as of
from strandflow.operators import pairs as pr
from strandflow.operators import scaffolds as sc
from strandflow.operators import traverse as tv
from strandflow.operators import variants as va
from strandflow.operators.programme import path_counts, path_steps
from strandflow.plans import tables as tb
from strandflow.plans.tables import ARCS_SQL, CONN_SQL, CONTIG_SQL, DNA_SQL, NODES_SQL, PLACED_SQL, SCAF_SQL, THREADS_SQL

FLAGSHIP = "kmer_spectrum"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LANGS = ["de", "en", "es", "fr"]
K = 11


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must agree with it where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _kmers_sql(k: int, frm: str = "dna", cols: str = "doc_id, lang") -> str:
    return f"km AS (SELECT {cols}, substr(seq, CAST(i AS INTEGER), {k}) AS kmer, i - 1 AS pos FROM (SELECT {cols}, seq, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) AS i FROM {frm}))"


_COUNTS_SQL = f"WITH {DNA_SQL}, {_kmers_sql(K)}, counts AS (SELECT lang, least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM km GROUP BY ALL), wide AS (SELECT kmer, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (lang = '{x}'), 0) AS BIGINT) AS {x}" for x in LANGS
) + " FROM counts GROUP BY kmer)"


def _abundance(spark, sf_dir):
    counts = km.spectrum(tb.dna(spark, sf_dir), K, ["lang"])
    return km.tabulate(counts, "lang", LANGS)


def _counts_array(wide):
    return wide.select("kmer", F.array(*LANGS).alias("counts"))


def _pattern_sql(x: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {x} >= {hi} THEN '1' WHEN {x} <= {lo} THEN '0' ELSE '-' END"


@query(_COUNTS_SQL + " SELECT kmer, de, en, es, fr, " + " || ".join(_pattern_sql(x, 2, 20) for x in LANGS) + " AS pattern FROM wide")
def kmer_spectrum(spark, sf_dir):
    """Canonical k-mers tabulated by language, with the ternary pattern of their abundances."""
    return _abundance(spark, sf_dir).withColumn("pattern", km.print_pattern(km.pattern(F.array(*LANGS), 2, 20)))


@query(f"WITH {DNA_SQL}, {_kmers_sql(K)}, counts AS (SELECT lang, least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM km GROUP BY ALL), tot AS (SELECT lang, sum(n) AS t FROM counts GROUP BY lang), "
       "kept AS (SELECT kmer FROM counts GROUP BY kmer HAVING max(n) >= 50) SELECT kmer, " + ", ".join(f"round(coalesce(max(n * 100.0 / t) FILTER (lang = '{x}'), 0), 9) AS {x}" for x in LANGS)
       + " FROM counts JOIN tot USING (lang) JOIN kept USING (kmer) GROUP BY kmer")
def kmer_percentages(spark, sf_dir):
    counts = km.spectrum(tb.dna(spark, sf_dir), K, ["lang"])
    out = km.tabulate(counts, "lang", LANGS, percentage=True, min_count=50)
    return out.select("kmer", *[F.round(x, 9).alias(x) for x in LANGS])


@query(_COUNTS_SQL + ", p AS (SELECT " + " || ".join(_pattern_sql(x, 2, 20) for x in LANGS) + " AS loose, " + " || ".join(f"CASE WHEN {x} > 30 THEN '1' WHEN {x} < 5 THEN '0' ELSE '-' END" for x in LANGS)
       + " AS strict FROM wide), c AS (SELECT loose, strict, count(*) AS n FROM p GROUP BY ALL) SELECT loose, strict, n, loose = strict AS same, "
       + " AND ".join(f"NOT (loose[{i}] = '1' AND strict[{i}] <> '1')" for i in range(1, 5)) + " AS consistent FROM c")
def kmer_patterns(spark, sf_dir):
    """Inclusive against strict patterns: how often each pair occurs, and whether they are the same or consistent."""
    p = _abundance(spark, sf_dir).select(km.print_pattern(km.pattern(F.array(*LANGS), 2, 20)).alias("loose"), km.print_pattern(km.strict_pattern(F.array(*LANGS), 5, 30)).alias("strict"))
    c = p.groupBy("loose", "strict").agg(F.count("*").alias("n"))
    a, b = km.parse_pattern(F.col("loose")), km.parse_pattern(F.col("strict"))
    return c.withColumn("same", km.same_as(a, b)).withColumn("consistent", km.consistent_with(a, b))


@query(_COUNTS_SQL + ", p AS (SELECT " + " + ".join(f"(CASE WHEN {x} >= 20 THEN {8 >> i} ELSE 0 END)" for i, x in enumerate(LANGS)) + " AS pattern FROM wide) "
       "SELECT CAST(r.i AS BIGINT) AS pattern, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM p WHERE p.pattern = r.i) AS n FROM range(1, (SELECT max(pattern) FROM p) + 1) r(i)")
def kmer_profile_histogram(spark, sf_dir):
    return km.profile_histogram(_counts_array(_abundance(spark, sf_dir)), 20)


@query(_COUNTS_SQL + f", bad AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, least(kmer, {_rc('kmer')}) AS kmer FROM km) JOIN wide USING (kmer) WHERE en + de + es + fr < 2) "
       "SELECT doc_id, length(seq) AS bases FROM dna WHERE doc_id NOT IN (SELECT doc_id FROM bad)")
def kmer_path_filter(spark, sf_dir):
    """Sequences all of whose k-mers occur at least twice in the corpus."""
    seqs = tb.dna(spark, sf_dir)
    total = km.spectrum(seqs, K, []).select("kmer", F.array("count").alias("counts"))
    return km.filter_paths(seqs, total, [2], K, path_id="doc_id", both_strands=True).select("doc_id", F.length("seq").alias("bases"))


@query(_COUNTS_SQL + f" SELECT doc_id, CAST(pos AS BIGINT) AS position, coalesce(en, 0) AS coverage1, coalesce(fr, 0) AS coverage2 FROM km JOIN wide ON wide.kmer = least(km.kmer, {_rc('km.kmer')})")
def kmer_depths(spark, sf_dir):
    """Depth of every k-mer of every text in the English and French ones."""
    wide = _abundance(spark, sf_dir).select("kmer", F.array("en", "fr").alias("counts"))
    return km.depths(tb.dna(spark, sf_dir), wide, K, 2, "doc_id", both_strands=True).withColumn("position", F.col("position").cast("long"))


_WHITE_SQL = f"w0 AS (SELECT DISTINCT substr(translate(md5(CAST(p_partkey AS VARCHAR)), '{tb.HEX}', '{tb.HEX_BASES}'), 1, 8) AS kmer FROM part), white AS (SELECT kmer FROM w0 UNION SELECT {_rc('kmer')} FROM w0), " \
    f"b0 AS (SELECT DISTINCT substr(translate(md5('s' || CAST(s_suppkey AS VARCHAR)), '{tb.HEX}', '{tb.HEX_BASES}'), 1, 8) AS kmer FROM supplier), black AS (SELECT kmer FROM b0 UNION SELECT {_rc('kmer')} FROM b0)"


@query(f"WITH {DNA_SQL}, {_kmers_sql(8, cols='doc_id, length(seq) AS n, seq').replace('SELECT doc_id, length(seq) AS n, seq, substr', 'SELECT doc_id, n, substr').replace('(SELECT doc_id, length(seq) AS n, seq, seq, unnest', '(SELECT doc_id, length(seq) AS n, seq, unnest')}, {_WHITE_SQL}, "
       f"hits AS (SELECT DISTINCT doc_id, least(kmer, {_rc('kmer')}) AS kmer FROM km WHERE kmer IN (SELECT kmer FROM white) AND greatest(n - pos - 8, pos) >= 3 AND doc_id NOT IN (SELECT doc_id FROM km WHERE kmer IN (SELECT kmer FROM black))), "
       "turns AS (SELECT doc_id, row_number() OVER (PARTITION BY kmer ORDER BY doc_id) AS t FROM hits) SELECT DISTINCT doc_id FROM turns WHERE t <= 2")
def read_selection(spark, sf_dir):
    """Reads by white- and blacklisted k-mers, two reads for each k-mer at most."""
    kmer = lambda name, key, p: tb.table(spark, sf_dir, name).select(F.substring(F.translate(F.md5(F.concat(F.lit(p), F.col(key).cast("string"))), tb.HEX, tb.HEX_BASES), 1, 8).alias("kmer")).distinct()
    reads = tb.dna(spark, sf_dir).select("doc_id", "seq")
    return km.select_reads(reads, kmer("part", "p_partkey", ""), kmer("supplier", "s_suppkey", "s"), 2, 3, "doc_id", "seq", 8).select("doc_id")


@query(f"WITH {CONTIG_SQL} SELECT doc_id AS scaffold_idx, CAST(contig_idx AS BIGINT) AS contig_idx, start, stop, 'doc' || doc_id || '_' || (contig_idx + 1) || 'of' || contigs || '_' || start || 'to' || stop AS contig_name, md5(seq) AS digest FROM contigs")
def scaffold_contigs(spark, sf_dir):
    c = sc.contig_names(sc.break_scaffolds(tb.scaffolds(spark, sf_dir)))
    return c.select("scaffold_idx", F.col("contig_idx").cast("long").alias("contig_idx"), "start", "stop", "contig_name", F.md5("seq").alias("digest"))


_GAPS_SQL = CONTIG_SQL + ", g0 AS (SELECT doc_id, start AS next, lag(stop) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM contigs), gaps AS (SELECT doc_id, prev + 1 AS start, next - 1 AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY next) - 1 AS gap_no FROM g0 WHERE prev IS NOT NULL)"


@query(f"WITH {_GAPS_SQL} SELECT doc_id AS scaffold_idx, CAST(gap_no AS BIGINT) AS gap_no, start, stop, 'doc' || doc_id || ':' || start || '-' || stop AS coords FROM gaps")
def scaffold_gaps(spark, sf_dir):
    g = sc.gaps(sc.break_scaffolds(tb.scaffolds(spark, sf_dir)))
    return g.select("scaffold_idx", F.col("gap_no").cast("long").alias("gap_no"), "start", "stop", "coords")


@query(f"WITH {SCAF_SQL} SELECT doc_id AS scaffold_idx, md5(regexp_replace(regexp_replace(seq, '^N+', ''), 'N+$', '')) AS digest FROM scaf")
def scaffold_rebuild(spark, sf_dir):
    """Broken and joined again: the scaffold without the N at its ends."""
    return sc.rebuilt(sc.break_scaffolds(tb.scaffolds(spark, sf_dir))).select("scaffold_idx", F.md5("seq").alias("digest"))


@query(f"WITH {CONTIG_SQL}, p AS (SELECT doc_id, contig_idx, 0 AS k, 'start' AS side, {_rc('substr(seq, 1, 6)')} AS seq FROM contigs WHERE length(seq) >= 12 UNION ALL SELECT doc_id, contig_idx, 1, 'end', right(seq, 6) FROM contigs WHERE length(seq) >= 12) "
       "SELECT row_number() OVER (ORDER BY doc_id, contig_idx, k) AS probe_no, doc_id AS scaffold_idx, side, seq FROM p")
def contig_end_probes(spark, sf_dir):
    c = sc.long_contigs(sc.break_scaffolds(tb.scaffolds(spark, sf_dir)), 6)
    return sc.end_probes(c, 6).select(F.col("probe_no").cast("long").alias("probe_no"), "scaffold_idx", "side", "seq")


@query(f"WITH {CONTIG_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY doc_id, contig_idx) AS r FROM contigs WHERE length(seq) >= 12), g AS (SELECT doc_id, 2 * r AS e, lead(2 * r - 1) OVER (PARTITION BY doc_id ORDER BY r) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS gap_no FROM c) "
       "SELECT doc_id AS scaffold_idx, CAST(gap_no AS BIGINT) AS gap_no, CAST(e AS BIGINT) AS end_probe, CAST(s AS BIGINT) AS start_probe, CAST(min(e - 1) OVER (PARTITION BY doc_id) AS BIGINT) AS first_probe FROM g QUALIFY s IS NOT NULL")
def gap_probe_pairs(spark, sf_dir):
    probes = sc.end_probes(sc.long_contigs(sc.break_scaffolds(tb.scaffolds(spark, sf_dir)), 6), 6)
    out = sc.probe_pairs(probes).join(sc.scaffold_end_probes(probes), "scaffold_idx")
    return out.select("scaffold_idx", *[F.col(c).cast("long").alias(c) for c in ("gap_no", "end_probe", "start_probe", "first_probe")])


@query(f"WITH {DNA_SQL}, p AS (SELECT doc_id, seq, unnest(range(0, greatest(length(seq) - 101 + 1, 0), 500)) AS o FROM dna) SELECT doc_id AS scaffold_idx, CAST(o AS BIGINT) AS \"offset\", substr(seq, CAST(o + 1 AS INTEGER), 100) AS seq FROM p")
def tiled_probes(spark, sf_dir):
    seqs = tb.dna(spark, sf_dir).select(F.col("doc_id").alias("scaffold_idx"), "seq")
    return sc.tiled_probes(seqs, 500, 100).withColumn("offset", F.col("offset").cast("long"))


@query(f"WITH {_GAPS_SQL} SELECT doc_id AS scaffold_idx, CAST(gap_no AS BIGINT) AS gap_no, l AS \"left\", {_rc('r')} AS \"right\" FROM (SELECT g.*, substr(s.seq, CAST(g.start - 5 AS INTEGER), 5) AS l, substr(s.seq, CAST(g.stop + 1 AS INTEGER), 6) AS r, length(s.seq) AS n FROM gaps g JOIN scaf s USING (doc_id)) "
       "WHERE start - 5 >= 1 AND stop + 6 <= n AND NOT contains(l, 'N') AND NOT contains(r, 'N')")
def gap_probes(spark, sf_dir):
    return sc.gap_probes(tb.scaffolds(spark, sf_dir), 5).withColumn("gap_no", F.col("gap_no").cast("long"))


@query(f"WITH {ARCS_SQL} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM edges")
def oriented_edges(spark, sf_dir):
    e = gr.oriented_edges(tb.arcs(spark, sf_dir))
    return e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"WITH {ARCS_SQL} SELECT CAST(src AS BIGINT) AS src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours, count(*) AS degree FROM edges WHERE src % 10 <> 0 OR true GROUP BY src".replace(" WHERE src % 10 <> 0 OR true", ""))
def node_neighbours(spark, sf_dir):
    e = gr.oriented_edges(tb.arcs(spark, sf_dir))
    n = gr.neighbours(e, e.select("src"))
    return n.groupBy(F.col("src").cast("long").alias("src")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("neighbours"), F.count("*").alias("degree"))


@query(f"WITH {NODES_SQL}, {ARCS_SQL}, {PLACED_SQL}, kept AS (SELECT node_id FROM nodes WHERE cov_sum / length >= 60 UNION SELECT node_id FROM noded_reads WHERE read_id IN (SELECT s_suppkey FROM supplier)) "
       "SELECT begin_id, begin_fwd, end_id, end_fwd, mult, n FROM arcs, (SELECT count(*) AS n FROM nodes WHERE node_id IN (SELECT node_id FROM kept)) WHERE begin_id IN (SELECT node_id FROM kept) AND end_id IN (SELECT node_id FROM kept)")
def coverage_filter(spark, sf_dir):
    g = gr.AssemblyGraph(tb.nodes(spark, sf_dir), tb.arcs(spark, sf_dir), 31, tb.noded_reads(spark, sf_dir))
    kept = gr.coverage_filter(g, 60, tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("read_id")))
    n = kept.nodes.agg(F.count("*").alias("n"))
    return kept.arcs.withColumn("begin_id", F.col("begin_id").cast("long")).withColumn("end_id", F.col("end_id").cast("long")).crossJoin(F.broadcast(n))  # one row


@query(f"WITH {PLACED_SQL}, m AS (SELECT p.read_id, n.node_id, n.fwd, n.\"offset\", n.start_coord, row_number() OVER (PARTITION BY p.read_id ORDER BY n.start_coord, n.node_id, n.\"offset\", n.fwd) AS k FROM (SELECT s_suppkey * 3 AS read_id FROM supplier) p JOIN noded_reads n USING (read_id)) "
       "SELECT s_suppkey AS probe_idx, s_suppkey * 3 AS read_id, node_id, fwd, \"offset\", start_coord FROM supplier LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON m.read_id = s_suppkey * 3")
def probe_lookup(spark, sf_dir):
    probes = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("probe_idx"), (F.col("s_suppkey") * 3).alias("read_id"))
    return gr.find_probes(tb.noded_reads(spark, sf_dir), probes)


@query(f"WITH {PLACED_SQL} SELECT s_suppkey + 1 AS probe_no FROM supplier WHERE s_suppkey * 211 NOT IN (SELECT read_id FROM noded_reads)")
def missing_probes(spark, sf_dir):
    probes = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("probe_idx"), (F.col("s_suppkey") * 211).alias("read_id"))
    return gr.missing_probes(gr.find_probes(tb.noded_reads(spark, sf_dir), probes))


@query(f"WITH {PLACED_SQL} SELECT s_suppkey AS probe_number, CASE WHEN n.node_id IS NULL THEN '-' ELSE CAST(n.node_id AS VARCHAR) END AS node, CASE WHEN n.node_id IS NULL THEN '-' WHEN n.fwd THEN 'forward' ELSE 'reverse' END AS direction FROM supplier LEFT JOIN noded_reads n ON n.read_id = s_suppkey * 211")
def probe_map(spark, sf_dir):
    """Probe to node table, '-' where a probe has none."""
    probes = tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("probe_idx"), (F.col("s_suppkey") * 211).alias("read_id"))
    f = gr.find_probes(tb.noded_reads(spark, sf_dir), probes)
    return f.select(F.col("probe_idx").alias("probe_number"), F.coalesce(F.col("node_id").cast("string"), F.lit("-")).alias("node"), F.when(F.col("node_id").isNull(), "-").when(F.col("fwd"), "forward").otherwise("reverse").alias("direction"))


@query(f"WITH {PLACED_SQL} SELECT DISTINCT a.node_id, b.node_id AS mate_node_id FROM noded_reads a JOIN pairs USING (read_id) JOIN noded_reads b ON b.read_id = pairs.pair_id")
def paired_nodes(spark, sf_dir):
    return gr.paired_nodes(tb.noded_reads(spark, sf_dir), tb.pairs(spark, sf_dir))


_PAIRED_SQL = f"""{NODES_SQL}, {PLACED_SQL}, rows AS (SELECT CASE WHEN a.fwd THEN a.node_id ELSE -a.node_id END AS src, CASE WHEN b.fwd THEN -b.node_id ELSE b.node_id END AS dst,
  200 - (x.length - a."offset" + a.start_coord) - (y.length - b."offset" + b.start_coord) AS gap FROM noded_reads a JOIN pairs p ON p.read_id = a.read_id JOIN noded_reads b ON b.read_id = p.pair_id
  JOIN nodes x ON x.node_id = a.node_id JOIN nodes y ON y.node_id = b.node_id WHERE a.node_id <> b.node_id AND y.cov_sum / y.length <= 300),
votes AS (SELECT src, dst, count(*) AS n, avg(gap) AS gap FROM rows WHERE gap <= 400 AND gap >= -200 GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY src, abs(dst) ORDER BY n DESC, dst DESC) AS r FROM votes),
paired AS (SELECT src, dst, greatest(gap, 0) AS gap, n FROM won WHERE r = 1 AND n >= 2)"""


@query(f"WITH {_PAIRED_SQL} SELECT src, dst, round(gap, 6) AS gap, n FROM paired")
def paired_neighbours(spark, sf_dir):
    p = pr.paired_neighbours(tb.noded_reads(spark, sf_dir), tb.pairs(spark, sf_dir), tb.nodes(spark, sf_dir), 200)
    return p.withColumn("gap", F.round("gap", 6))


@query(f"WITH {_PAIRED_SQL} SELECT abs(src) AS node_id, array_to_string(list_sort(list(DISTINCT abs(dst))), ',') AS links FROM paired GROUP BY abs(src)")
def paired_links(spark, sf_dir):
    p = pr.paired_neighbours(tb.noded_reads(spark, sf_dir), tb.pairs(spark, sf_dir), tb.nodes(spark, sf_dir), 200)
    return pr.paired_links(p).select("node_id", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"))


_STARTS = "starts AS (SELECT s_suppkey AS source, CAST(s_suppkey % (SELECT count(*) FROM part) + 1 AS BIGINT) AS start FROM supplier)"


def _starts(spark, sf_dir):
    n = tb.table(spark, sf_dir, "part").count()
    return tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % n + 1).cast("int").alias("start"))


def _dist_sql(leash: int, edges: str = "edges", starts: str = "SELECT source, start AS node FROM starts") -> str:
    return f"""r AS (SELECT source, node, CAST(0 AS BIGINT) AS dist, true AS first FROM ({starts})
  UNION SELECT r.source, e.dst, r.dist + CASE WHEN r.first THEN 0 ELSE n.length END, false FROM r JOIN {edges} e ON e.src = r.node JOIN nodes n ON n.node_id = abs(r.node)
  WHERE r.dist + CASE WHEN r.first THEN 0 ELSE n.length END <= {leash}),
best AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL)"""


@query(f"WITH RECURSIVE {NODES_SQL}, {ARCS_SQL}, {_STARTS}, {_dist_sql(3)} SELECT source, CAST(node AS BIGINT) AS node, dist FROM best")
def min_distances(spark, sf_dir):
    """Shortest distances from probe nodes within a leash, over the whole graph."""
    g = gr.AssemblyGraph(tb.nodes(spark, sf_dir), tb.steps(spark, sf_dir), 31)
    d = tv.min_distances(g.edges_as_they_come(), g.nodes, _starts(spark, sf_dir), 3)
    return d.withColumn("node", F.col("node").cast("long"))


_ANYWAY = "anyway AS (SELECT a * abs(src) AS src, b * abs(dst) AS dst FROM edges, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) AS s(a, b))"


@query(f"WITH RECURSIVE {THREADS_SQL}, {_ANYWAY}, " + _dist_sql(40, "anyway", "SELECT source, unnest([start, -start]) AS node FROM starts") + " SELECT source, CAST(node AS BIGINT) AS node, dist FROM best")
def distances_any_direction(spark, sf_dir):
    """Shortest distances from each customer's first order, whatever the direction."""
    g = tb.thread_graph(spark, sf_dir)
    out = tv.min_distances(g.edges(), g.nodes, tb.thread_starts(spark, sf_dir), 40, ignore_directions=True)
    return out.withColumn("node", F.col("node").cast("long"))


@query(f"WITH RECURSIVE {THREADS_SQL}, {_dist_sql(90)}, ids AS (SELECT source, abs(node) AS node_id, min(dist) AS dist FROM best GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, node_id) AS r FROM ids), cut AS (SELECT source, max(dist) AS c FROM k WHERE r <= 6 GROUP BY source) "
       "SELECT source, CAST(node AS BIGINT) AS node, dist FROM best JOIN cut USING (source) WHERE dist <= c")
def nearest_nodes(spark, sf_dir):
    """The five nearest nodes of each customer's first order with all ties."""
    g = tb.thread_graph(spark, sf_dir)
    out = tv.min_distances(g.edges(), g.nodes, tb.thread_starts(spark, sf_dir), 90, max_nodes=5)
    return out.withColumn("node", F.col("node").cast("long"))


@query(f"WITH RECURSIVE {THREADS_SQL}, {_dist_sql(40, 'edges', 'SELECT source, unnest([start, -start]) AS node FROM starts')}, near AS (SELECT DISTINCT abs(node) AS node_id FROM best), "
       "outside AS (SELECT DISTINCT abs(src) AS node_id FROM edges WHERE abs(src) IN (SELECT node_id FROM near) AND abs(dst) NOT IN (SELECT node_id FROM near)) SELECT CAST(node_id AS BIGINT) AS node_id, node_id IN (SELECT node_id FROM outside) AS boundary FROM near")
def nodes_within_leash(spark, sf_dir):
    g = tb.thread_graph(spark, sf_dir)
    out = tv.nodes_within_leash(g.edges(), g.nodes, tb.thread_starts(spark, sf_dir), 40)
    return out.withColumn("node_id", F.col("node_id").cast("long"))


@query(f"WITH RECURSIVE {ARCS_SQL}, sparse AS (SELECT begin_id AS a, end_id AS b FROM arcs WHERE mult >= 2), sym AS (SELECT a, b FROM sparse UNION SELECT b, a FROM sparse), "
       "r AS (SELECT s_suppkey + 1 AS node_id FROM supplier UNION SELECT s.b FROM r JOIN sym s ON s.a = r.node_id) SELECT DISTINCT CAST(node_id AS BIGINT) AS node_id FROM r WHERE node_id IN (SELECT p_partkey + 1 FROM part)")
def connected_nodes(spark, sf_dir):
    """Nodes connected to whitelisted ones by arcs seen at least twice."""
    e = gr.oriented_edges(tb.arcs(spark, sf_dir).where("mult >= 2"))
    white = tb.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("node_id"))
    return tv.connected_to(e, tb.nodes(spark, sf_dir), white).select(F.col("node_id").cast("long").alias("node_id"))


@query(f"WITH RECURSIVE {THREADS_SQL}, live AS (SELECT source, [start] AS path, CAST(n.length + 30 AS BIGINT) AS bp, CASE WHEN n.length + 30 > 90 THEN 'Leashed' END AS fate FROM starts JOIN nodes n ON n.node_id = abs(start) "
       "UNION ALL SELECT l.source, list_append(l.path, e.dst), l.bp + n.length, CASE WHEN list_contains(l.path, e.dst) THEN 'Loop' WHEN l.bp + n.length > 90 THEN 'Leashed' END FROM live l JOIN edges e ON e.src = l.path[-1] JOIN nodes n ON n.node_id = abs(e.dst) WHERE l.fate IS NULL) "
       "SELECT source, array_to_string(list_transform(path, lambda x: abs(x)), ',') AS path, coalesce(fate, 'Dead end / coverage') AS fate FROM live WHERE fate IS NOT NULL OR path[-1] NOT IN (SELECT src FROM edges)")
def explore_paths(spark, sf_dir):
    """All paths beyond each customer's first order, until the leash, a dead end or a node of their own."""
    g = tb.thread_graph(spark, sf_dir)
    out = tv.explore(g.edges(), g.nodes, tb.thread_starts(spark, sf_dir), g.k, 90)
    return out.select("source", tr.ids_only(F.col("path")).alias("path"), "fate")


@query(f"WITH RECURSIVE {THREADS_SQL}, live AS (SELECT source AS pair_id, stop, [start] AS path, CAST(0 AS BIGINT) AS bp FROM starts JOIN stops USING (source) WHERE start <> stop "
       "UNION ALL SELECT l.pair_id, l.stop, list_append(l.path, e.dst), l.bp + n.length FROM live l JOIN edges e ON e.src = l.path[-1] JOIN nodes n ON n.node_id = abs(e.src) WHERE l.path[-1] <> l.stop AND NOT list_contains(l.path, e.dst) AND l.bp + n.length <= 150) "
       "SELECT CAST(pair_id AS BIGINT) AS pair_id, array_to_string(list_transform(path, lambda x: abs(x)), ',') AS path FROM live WHERE path[-1] = stop")
def gap_paths(spark, sf_dir):
    """All acyclic paths within a leash from each customer's first order to the last."""
    g = tb.thread_graph(spark, sf_dir)
    out, _ = tv.paths_between(g.edges_as_they_come(), g.nodes, tb.thread_pairs(spark, sf_dir), 150, max_paths=None)
    return out.select("pair_id", tr.ids_only(F.col("path")).alias("path"))


_PROGRAMME = f"""{THREADS_SQL}, pairs AS (SELECT source AS pair_id, start, stop FROM starts JOIN stops USING (source) WHERE start <> stop),
ahead AS (SELECT pair_id, start AS node, stop, CAST(0 AS BIGINT) AS d FROM pairs UNION SELECT a.pair_id, e.dst, a.stop, a.d + n.length FROM ahead a JOIN edges e ON e.src = a.node JOIN nodes n ON n.node_id = abs(e.src) WHERE a.node <> a.stop AND a.d + n.length <= 100),
fwd AS (SELECT pair_id, node, min(d) AS used FROM ahead GROUP BY ALL),
behind AS (SELECT pair_id, stop AS node, CAST(0 AS BIGINT) AS d FROM pairs UNION SELECT b.pair_id, e.src, b.d + n.length FROM behind b JOIN edges e ON e.dst = b.node JOIN nodes n ON n.node_id = abs(e.src) WHERE b.d + n.length <= 100),
bwd AS (SELECT pair_id, node, min(d) AS rest FROM behind GROUP BY ALL),
steps AS (SELECT f.pair_id, e.src, e.dst, f.used + n.length AS used, b.rest FROM fwd f JOIN pairs p ON p.pair_id = f.pair_id AND f.node <> p.stop JOIN edges e ON e.src = f.node JOIN nodes n ON n.node_id = abs(e.src)
  JOIN bwd b ON b.pair_id = f.pair_id AND b.node = e.dst WHERE f.used + n.length + b.rest <= 100)"""


def _programme(spark, sf_dir):
    g, pairs = tb.thread_graph(spark, sf_dir), tb.thread_pairs(spark, sf_dir)
    return path_steps(g.edges_as_they_come(), g.nodes, pairs, 100), pairs


@query(f"WITH RECURSIVE {_PROGRAMME} SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(used AS BIGINT) AS used, CAST(rest AS BIGINT) AS rest FROM steps")
def gap_path_steps(spark, sf_dir):
    """The steps of all walks within a leash from each customer's first order to the last."""
    return _programme(spark, sf_dir)[0].select(*[F.col(c).cast("long").alias(c) for c in ("pair_id", "src", "dst", "used", "rest")])


@query(f"WITH RECURSIVE {_PROGRAMME}, reach AS (SELECT pair_id, src AS a, dst AS b FROM steps UNION SELECT r.pair_id, r.a, s.dst FROM reach r JOIN steps s ON s.pair_id = r.pair_id AND s.src = r.b), "
       "round AS (SELECT DISTINCT pair_id FROM reach WHERE a = b), ways AS (SELECT pair_id, start AS node FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM round) UNION ALL SELECT w.pair_id, s.dst FROM ways w JOIN steps s ON s.pair_id = w.pair_id AND s.src = w.node), "
       "n AS (SELECT p.pair_id, count(*) AS n FROM ways w JOIN pairs p ON p.pair_id = w.pair_id AND w.node = p.stop GROUP BY p.pair_id), least AS (SELECT s.pair_id, min(used) AS least FROM steps s JOIN pairs p ON p.pair_id = s.pair_id AND s.dst = p.stop GROUP BY s.pair_id) "
       "SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(least AS BIGINT) AS least, CASE WHEN pair_id NOT IN (SELECT pair_id FROM round) THEN CAST(coalesce(n, 0) AS BIGINT) END AS paths, pair_id IN (SELECT pair_id FROM round) AS circular FROM pairs LEFT JOIN n USING (pair_id) LEFT JOIN least USING (pair_id)")
def gap_path_counts(spark, sf_dir):
    """The shortest path and the number of paths from each customer's first order to the last, none being listed; the number is given where there is no cycle."""
    steps, pairs = _programme(spark, sf_dir)
    c = path_counts(steps, pairs)
    return c.select(F.col("pair_id").cast("long").alias("pair_id"), "least", F.when(~F.col("circular"), F.col("paths").cast("long")).alias("paths"), "circular")


def _loops_sql(n: int) -> str:
    """Loops of the steps step{n}: the nodes of their cycles with the head of each, which walks come to first, the steps back to it, and step{n + 1}, what is left of them."""
    return f"""reach{n} AS (SELECT src AS a, dst AS b FROM step{n} UNION SELECT r.a, e.dst FROM reach{n} r JOIN step{n} e ON e.src = r.b),
  head{n} AS (SELECT r.a AS node, min_by(r.b, (d.d, r.b)) AS head FROM reach{n} r JOIN depth d ON d.node = r.b WHERE EXISTS (SELECT 1 FROM reach{n} x WHERE x.a = r.b AND x.b = r.a) GROUP BY r.a),
  inner{n} AS (SELECT e.src, e.dst, y.head FROM step{n} e JOIN head{n} x ON x.node = e.src JOIN head{n} y ON y.node = e.dst WHERE x.head = y.head),
  step{n + 1} AS (SELECT src, dst FROM inner{n} WHERE dst <> head)"""


_NESTED = 4  # loops within loops in the graph of orders, at most
_LEVELS = f"""{THREADS_SQL}, roots AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)),
walk AS (SELECT node, 0 AS d FROM roots UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.d < (SELECT 2 * max(n) FROM (SELECT count(*) AS n FROM thread GROUP BY cust))), depth AS (SELECT node, min(d) AS d FROM walk GROUP BY node),
inside AS (SELECT * FROM edges WHERE src IN (SELECT node FROM depth)), step0 AS (SELECT * FROM inside WHERE src <> dst), {", ".join(_loops_sql(n) for n in range(_NESTED))},
cut AS (SELECT src, dst FROM inside WHERE src = dst {" ".join(f"UNION SELECT src, dst FROM inner{n} WHERE dst = head" for n in range(_NESTED))}), kept AS (SELECT * FROM inside EXCEPT SELECT * FROM cut),
tips AS (SELECT node FROM depth WHERE node NOT IN (SELECT src FROM inside)), opened AS (SELECT node FROM tips UNION SELECT k.src FROM opened o JOIN kept k ON k.dst = o.node),
told AS (SELECT * FROM kept WHERE src NOT IN (SELECT node FROM opened) OR dst IN (SELECT node FROM opened)),
up AS (SELECT node, 0 AS h FROM depth WHERE node NOT IN (SELECT src FROM told) UNION SELECT t.src, u.h + 1 FROM up u JOIN told t ON t.dst = u.node), high AS (SELECT node, max(h) AS level FROM up GROUP BY node),
below AS (SELECT dst AS node FROM kept WHERE src IN (SELECT node FROM opened) AND dst NOT IN (SELECT node FROM opened) UNION SELECT k.dst FROM below b JOIN kept k ON k.src = b.node),
levels AS (SELECT node, CASE WHEN node NOT IN (SELECT node FROM below) THEN level END AS level FROM high)"""


def _levels(spark, sf_dir):
    """Levels of what the beginnings of the graph of orders come to."""
    e = tb.thread_graph(spark, sf_dir).edges_as_they_come()
    ends = e.select(F.col("src").alias("node"), F.lit(True).alias("out")).unionByName(e.select(F.col("dst").alias("node"), F.lit(False).alias("out")))
    return cy.levels(e, ends.groupBy("node").agg(F.bool_and("out").alias("first")).where("first").select("node"))


@query(f"WITH RECURSIVE {_LEVELS} SELECT CAST(node AS BIGINT) AS node, CAST(level AS BIGINT) AS level FROM levels")
def node_heights(spark, sf_dir):
    """Levels of what the graph's beginnings reach, cycles cut open."""
    return _levels(spark, sf_dir).nodes().select(F.col("node").cast("long").alias("node"), F.col("level").cast("long").alias("level"))


@query(f"WITH RECURSIVE {_LEVELS}, known AS (SELECT * FROM levels WHERE level IS NOT NULL), p AS (SELECT k.dst, min(l.level) AS level FROM kept k JOIN known l ON l.node = k.src WHERE k.dst IN (SELECT node FROM known) GROUP BY k.dst), "
       "ch AS (SELECT level, sum(d) AS d FROM (SELECT level, 1 AS d FROM known UNION ALL SELECT level, -1 FROM p) GROUP BY level), live AS (SELECT sum(d) OVER (ORDER BY level) AS live FROM ch) SELECT CAST(coalesce(max(live), 0) AS BIGINT) AS min_paths FROM live")
def min_path_count(spark, sf_dir):
    """The greatest number of nodes alive at a level."""
    return _levels(spark, sf_dir).min_paths()


@query(f"WITH RECURSIVE {_LEVELS}, ways AS (SELECT row_number() OVER () AS id, node FROM levels WHERE node IN (SELECT node FROM roots) AND level IS NOT NULL UNION ALL SELECT w.id, t.dst FROM ways w JOIN told t ON t.src = w.node) "
       "SELECT CAST(count(*) AS BIGINT) AS max_paths FROM ways WHERE node NOT IN (SELECT src FROM told)")
def max_path_count(spark, sf_dir):
    """The number of paths from the graph's beginnings to its tips, cycles cut open."""
    return _levels(spark, sf_dir).max_paths().select(F.col("max_paths").cast("long").alias("max_paths"))


@query(f"WITH RECURSIVE {_LEVELS}, loops AS (SELECT src, dst, src AS node FROM cut UNION SELECT l.src, l.dst, k.src FROM loops l JOIN kept k ON k.dst = l.node WHERE l.node <> l.dst), "
       "led AS (SELECT src, dst, dst AS node FROM cut UNION SELECT l.src, l.dst, k.dst FROM led l JOIN kept k ON k.src = l.node) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(node AS BIGINT) AS node FROM (SELECT * FROM loops INTERSECT SELECT * FROM led)")
def loop_nodes(spark, sf_dir):
    """The nodes of each loop of the graph of orders, by the step at which it is cut open."""
    return _levels(spark, sf_dir).cycles().select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst", "node")])


@query(f"WITH RECURSIVE {THREADS_SQL}, ids AS (SELECT node_id AS node FROM nodes UNION ALL SELECT -node_id FROM nodes), either AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT node AS a, node AS b FROM ids UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b), "
       "lead AS (SELECT a AS node, arg_min(b, abs(b) * 2 + CASE WHEN b > 0 THEN 0 ELSE 1 END) AS low FROM reach GROUP BY a), mine AS (SELECT node FROM lead WHERE low > 0) "
       "SELECT CAST(node AS BIGINT) AS node, 'start' AS kind FROM mine WHERE node NOT IN (SELECT dst FROM edges) UNION ALL SELECT CAST(node AS BIGINT), 'end' FROM mine WHERE node NOT IN (SELECT src FROM edges)")
def range_ends(spark, sf_dir):
    """Where walks through the graph of orders begin and end."""
    g = tb.thread_graph(spark, sf_dir)
    return tv.range_edges(g.edges(), g.nodes).withColumn("node", F.col("node").cast("long"))


_PATHS_SQL = "p0 AS (SELECT l_orderkey AS path_id, (l_partkey + 1) * CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)"


def _paths(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = tb.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), tr.oriented((F.col("l_partkey") + 1).cast("int"), F.col("l_returnflag") != "R").alias("n"), F.row_number().over(w).alias("i"))
    return rows.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("path"))


@query(f"WITH {NODES_SQL}, {_PATHS_SQL}, s AS (SELECT path_id, string_agg(CASE WHEN n > 0 THEN ends_fwd ELSE ends_twin END, '' ORDER BY i) AS f, string_agg(CASE WHEN n > 0 THEN ends_twin ELSE ends_fwd END, '' ORDER BY i DESC) AS t, "
       "string_agg(abs(n) || CASE WHEN n > 0 THEN 's' ELSE 'e' END, ',' ORDER BY i) AS trail FROM p0 JOIN nodes ON node_id = abs(n) GROUP BY path_id) "
       f"SELECT path_id, trail, substr({_rc('t')}, 1, 2) || f AS seq FROM s WHERE length(t) >= 2")
def trail_sequences(spark, sf_dir):
    """The DNA of every order's node path at k = 3 (paths of one base have none)."""
    nodes = tb.nodes(spark, sf_dir)
    paths = _paths(spark, sf_dir)
    long = gr.trail_coverage(paths, nodes).where("bp >= 2").select("path_id")
    return gr.trail_sequences(paths.join(long, "path_id", "left_semi"), nodes, 3).join(paths.select("path_id", tr.shorthand(F.col("path")).alias("trail")), "path_id")


@query(f"WITH {NODES_SQL}, {_PATHS_SQL} SELECT path_id, round(sum(cov_sum) / sum(length), 9) AS coverage, CAST(sum(length) AS BIGINT) AS bp FROM p0 JOIN nodes ON node_id = abs(n) GROUP BY path_id")
def trail_coverage(spark, sf_dir):
    return gr.trail_coverage(_paths(spark, sf_dir), tb.nodes(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {NODES_SQL}, {_PATHS_SQL}, c AS (SELECT path_id, sum(cov_sum) / sum(length) AS coverage FROM p0 JOIN nodes ON node_id = abs(n) GROUP BY path_id) SELECT o_custkey, arg_min(path_id, (-coverage, path_id)) AS path_id FROM c JOIN orders ON o_orderkey = path_id GROUP BY o_custkey")
def best_covered_paths(spark, sf_dir):
    paths = _paths(spark, sf_dir).join(tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), "o_custkey"), "path_id")
    return gr.best_covered(paths, tb.nodes(spark, sf_dir), "o_custkey")


@query(f"WITH {ARCS_SQL}, {_PATHS_SQL}, st AS (SELECT path_id, n AS src, lead(n) OVER (PARTITION BY path_id ORDER BY i) AS dst FROM p0), strong0 AS (SELECT CASE WHEN begin_fwd THEN begin_id ELSE -begin_id END AS src, CASE WHEN end_fwd THEN end_id ELSE -end_id END AS dst FROM arcs WHERE mult >= 2), "
       "strong AS (SELECT src, dst FROM strong0 UNION SELECT -dst, -src FROM strong0) SELECT path_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM st WHERE dst IS NOT NULL AND (src, dst) NOT IN (SELECT (src, dst) FROM strong)")
def broken_trail_steps(spark, sf_dir):
    """Steps of node paths that arcs seen at least twice don't allow."""
    e = gr.oriented_edges(tb.arcs(spark, sf_dir).where("mult >= 2"))
    out = gr.broken_steps(_paths(spark, sf_dir), e)
    return out.select("path_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


_ENDS_SQL = CONN_SQL + ", ends AS (SELECT seq1 AS seq, side1 AS side FROM conn UNION ALL SELECT seq2, side2 FROM conn), one AS (SELECT seq, side FROM ends GROUP BY ALL HAVING count(*) = 1), seqs AS (SELECT DISTINCT seq FROM (SELECT s_suppkey AS seq FROM supplier UNION SELECT seq FROM ends))"


@query(f"WITH {CONN_SQL} SELECT seq1, side1, seq2, side2, distance, seq1 || substr(side1, 1, 1) || '/' || seq2 || substr(side2, 1, 1) || ':' || distance AS text FROM conn")
def connection_list(spark, sf_dir):
    return sc.connection_text(sc.checked_connections(tb.connections(spark, sf_dir)))


@query(f"WITH {_ENDS_SQL} SELECT seq1, side1, seq2, side2, distance FROM conn WHERE (seq1, side1) IN (SELECT (seq, side) FROM one) AND (seq2, side2) IN (SELECT (seq, side) FROM one)")
def doubly_single_connections(spark, sf_dir):
    return sc.doubly_single(tb.connections(spark, sf_dir)).select("seq1", "side1", "seq2", "side2", "distance")


def _sequences(spark, sf_dir):
    c = tb.connections(spark, sf_dir)
    return tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq")).union(c.select("seq1")).union(c.select("seq2")).distinct(), c


@query(f"WITH {_ENDS_SQL}, every AS (SELECT seq, unnest(['start', 'end']) AS side FROM seqs) SELECT seq, side FROM every EXCEPT SELECT seq, side FROM ends")
def unconnected_ends(spark, sf_dir):
    s, c = _sequences(spark, sf_dir)
    return sc.unconnected_ends(s, c)


_CHAINS_SQL = f"""WITH RECURSIVE {_ENDS_SQL}, singles AS (SELECT * FROM conn WHERE (seq1, side1) IN (SELECT (seq, side) FROM one) AND (seq2, side2) IN (SELECT (seq, side) FROM one)),
links AS (SELECT 2 * seq1 + CASE WHEN side1 = 'end' THEN 0 ELSE 1 END AS a, 2 * seq2 + CASE WHEN side2 = 'start' THEN 0 ELSE 1 END AS b, distance FROM singles WHERE seq1 <> seq2
  UNION ALL SELECT 2 * seq2 + CASE WHEN side2 = 'end' THEN 0 ELSE 1 END, 2 * seq1 + CASE WHEN side1 = 'start' THEN 0 ELSE 1 END, distance FROM singles WHERE seq1 <> seq2),
lists AS (SELECT a AS node, a AS head, 0 AS pos FROM links WHERE a NOT IN (SELECT b FROM links) UNION ALL SELECT k.b, l.head, l.pos + 1 FROM lists l JOIN links k ON k.a = l.node),
rest AS (SELECT * FROM links WHERE a NOT IN (SELECT node FROM lists)),
round AS (SELECT a AS node, a AS head, 0 AS pos FROM rest UNION ALL SELECT k.b, l.head, l.pos + 1 FROM round l JOIN rest k ON k.a = l.node WHERE k.b <> l.head),
ranked AS (SELECT *, false AS circular FROM lists UNION ALL SELECT node, min(head), min_by(pos, head), true FROM round GROUP BY node),
best AS (SELECT * FROM ranked QUALIFY head = min(head) OVER (PARTITION BY node >> 1))"""


@query(f"""{_CHAINS_SQL} SELECT head >> 1 AS scaffold, CAST(pos AS INTEGER) AS ord, node >> 1 AS seq, node % 2 = 0 AS fwd, links.distance AS gap_after, circular FROM best LEFT JOIN links ON a = node
UNION ALL SELECT s.seq, 0, s.seq, true, r.distance, r.distance IS NOT NULL FROM seqs s LEFT JOIN singles r ON r.seq1 = s.seq AND r.seq2 = s.seq AND r.side1 <> r.side2 WHERE s.seq NOT IN (SELECT node >> 1 FROM best)""")
def scaffold_chains(spark, sf_dir):
    """Sequences chained into scaffolds and rings by doubly single connections."""
    s, c = _sequences(spark, sf_dir)
    return sc.chains(s, c)


@query(f"""WITH {DNA_SQL}, al AS (SELECT lang AS g, doc_id, regexp_replace(substr(seq, 1, length(seq)), 'T', '-', 'g') AS aln FROM dna WHERE length(seq) > 0),
c AS (SELECT g, i, aln[i] AS b FROM (SELECT g, aln, unnest(range(1, length(aln) + 1)) AS i FROM al)),
m AS (SELECT g, i, CASE WHEN count(DISTINCT b) = 1 THEN min(b) WHEN count(*) FILTER (b = '-') * 2 >= count(*) THEN '-' ELSE 'N' END AS x FROM c GROUP BY ALL) SELECT g, md5(string_agg(x, '' ORDER BY i)) AS digest FROM m GROUP BY g""")
def alignment_consensus(spark, sf_dir):
    """Conservative consensus of each language's sequences laid side by side (T read as a gap)."""
    al = tb.dna(spark, sf_dir).where("length(seq) > 0").select(F.col("lang").alias("g"), F.col("doc_id").alias("path_id"), F.regexp_replace("seq", "T", "-").alias("aln"))
    return va.consensus(al, "g").select("g", F.md5("consensus").alias("digest"))


_VAR_SQL = f"""{DNA_SQL}, al AS (SELECT doc_id, source AS g, regexp_replace(seq, 'T', '-', 'g') AS aln FROM dna WHERE length(seq) > 0), ref AS (SELECT g, arg_min(aln, doc_id) AS aln, min(doc_id) AS d FROM al GROUP BY g),
rc AS (SELECT g, i, aln[i] AS r FROM (SELECT g, aln, unnest(range(1, length(aln) + 1)) AS i FROM ref)),
rp AS (SELECT *, coalesce(sum(CASE WHEN r <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rc),
ac AS (SELECT g, doc_id, i, aln[i] AS b FROM (SELECT al.g, al.doc_id, al.aln, unnest(range(1, length(al.aln) + 1)) AS i FROM al JOIN ref ON ref.g = al.g AND ref.d <> al.doc_id)),
d AS (SELECT g, doc_id, pos, i, b, CASE WHEN r = '-' THEN 'INSERT' WHEN b = '-' THEN 'DELETION' ELSE 'SWAP' END AS type FROM ac JOIN rp USING (g, i) WHERE r <> b),
n AS (SELECT *, CASE WHEN type = 'INSERT' THEN pos ELSE pos - row_number() OVER (PARTITION BY g, doc_id, type ORDER BY i) END AS island FROM d),
m AS (SELECT g, type, min(pos) AS pos, string_agg(b, '' ORDER BY i) AS s FROM n GROUP BY g, doc_id, type, island),
v AS (SELECT DISTINCT g, type, pos, CASE WHEN type <> 'DELETION' THEN s END AS seq, CASE WHEN type = 'DELETION' THEN length(s) END AS del_len FROM m)"""


def _variants(spark, sf_dir):
    al = tb.dna(spark, sf_dir).where("length(seq) > 0").select(F.col("source").alias("g"), F.col("doc_id").alias("path_id"), F.regexp_replace("seq", "T", "-").alias("aln"))
    ref = al.groupBy("g").agg(F.min_by("aln", "path_id").alias("aln"), F.min("path_id").alias("_d"))
    rest = al.join(ref.select("g", "_d"), "g").where("path_id != _d").drop("_d")
    return va.variants(ref.select("g", "aln"), rest, "g"), ref


@query(f"WITH {_VAR_SQL} SELECT g, pos || substr(type, 1, 1) || ':' || coalesce(seq, CAST(del_len AS VARCHAR)) AS text FROM v")
def alignment_variants(spark, sf_dir):
    """Variants of each source's sequences against its first, merged into islands."""
    v, _ = _variants(spark, sf_dir)
    return va.shorthand(v).select("g", "text")


@query(f"""WITH {_VAR_SQL}, s AS (SELECT g, replace(aln, '-', '') AS ref FROM ref) SELECT g AS "CHROM", CAST(CASE WHEN type = 'SWAP' THEN pos + 1 ELSE pos END AS BIGINT) AS "POS", '.' AS "ID",
CASE type WHEN 'SWAP' THEN substr(ref, CAST(pos + 1 AS INTEGER), length(seq)) WHEN 'INSERT' THEN CASE WHEN pos > 0 THEN substr(ref, CAST(pos AS INTEGER), 1) ELSE '' END ELSE CASE WHEN pos > 0 THEN substr(ref, CAST(pos AS INTEGER), 1) ELSE '' END || substr(ref, CAST(pos + 1 AS INTEGER), del_len) END AS "REF",
CASE type WHEN 'SWAP' THEN seq WHEN 'INSERT' THEN CASE WHEN pos > 0 THEN substr(ref, CAST(pos AS INTEGER), 1) ELSE '' END || seq ELSE CASE WHEN pos > 0 THEN substr(ref, CAST(pos AS INTEGER), 1) ELSE '' END END AS "ALT", '20' AS "QUAL", 'PASS' AS "FILTER", 'strandflow' AS "INFO" FROM v JOIN s USING (g)""")
def variant_calls(spark, sf_dir):
    v, ref = _variants(spark, sf_dir)
    whole = ref.select("g", F.regexp_replace("aln", "-", "").alias("ref"))
    return va.vcf_rows_over(v, whole, "g", "ref").withColumn("POS", F.col("POS").cast("long"))


_ORF_SQL = f"""{DNA_SQL}, strands AS (SELECT doc_id, '+' AS strand, seq AS s FROM dna UNION ALL SELECT doc_id, '-', {_rc('seq')} FROM dna),
co AS (SELECT doc_id, strand, i + 2 AS pos, substr(s, CAST(i AS INTEGER), 3) AS c FROM (SELECT doc_id, strand, s, unnest(range(1, greatest(length(s) - 1, 1))) AS i FROM strands)),
mk AS (SELECT doc_id, strand, pos, pos % 3 AS frame, c = 'ATG' AS is_start FROM co WHERE c IN ('ATG', 'TAA', 'TAG', 'TGA')),
kk AS (SELECT *, coalesce(sum(CASE WHEN is_start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, strand, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM mk),
sp AS (SELECT doc_id, strand, frame, k, min(pos) FILTER (is_start) AS start, max(pos) FILTER (NOT is_start) AS stop FROM kk GROUP BY ALL)"""


@query(f"WITH {_ORF_SQL} SELECT doc_id, strand, CAST(frame AS BIGINT) AS frame, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, 'pair' AS kind FROM sp WHERE stop - start >= 96 UNION ALL "
       "SELECT doc_id, strand, CAST(frame AS BIGINT), NULL, CAST(stop AS BIGINT), 'initial stop' FROM sp WHERE k = 0 AND stop IS NOT NULL UNION ALL SELECT doc_id, strand, CAST(frame AS BIGINT), CAST(start AS BIGINT), NULL, 'final start' FROM sp WHERE start IS NOT NULL AND stop IS NULL")
def orf_markers(spark, sf_dir):
    """Start and stop codons paired by frame on both strands of every sequence."""
    out = of.paired_codons(tb.dna(spark, sf_dir), 96, "doc_id")
    return out.select("doc_id", "strand", *[F.col(c).cast("long").alias(c) for c in ("frame", "start", "stop")], "kind")


_AMINO = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in sq.codon_table().items()) + "}"


@query(f"WITH {_ORF_SQL}, o AS (SELECT doc_id, strand, substr(s, CAST(start - 2 AS INTEGER), CAST(stop - start + 3 AS INTEGER)) AS orf FROM sp JOIN strands USING (doc_id, strand) WHERE stop - start + 3 >= 96) "
       f"SELECT doc_id, strand, md5(orf) AS orf, array_to_string(list_transform(range(1, length(orf) - 3, 3), lambda i: {_AMINO}[substr(orf, CAST(i AS INTEGER), 3)]), '') AS protein FROM o")
def closed_orf_proteins(spark, sf_dir):
    """Closed reading frames of at least 96 bases and their proteins."""
    o = of.proteins(of.orf_sequences(tb.dna(spark, sf_dir), 96, "doc_id").where("kind = 'pair'"))
    return o.select("doc_id", "strand", F.md5("orf").alias("orf"), "protein")


@query(f"WITH {NODES_SQL}, {ARCS_SQL} SELECT 'n' || node_id || '_length' || length || '_coverage' || CAST(round(cov_sum / length) AS BIGINT) AS label, (SELECT count(*) FROM arcs WHERE begin_id = node_id OR end_id = node_id) AS degree FROM nodes WHERE cov_sum / length >= 40")
def graph_labels(spark, sf_dir):
    """Labels of a drawing's nodes above a coverage, with the number of arcs at each."""
    from strandflow.sources.sinks import node_labels

    g = gr.AssemblyGraph(tb.nodes(spark, sf_dir), tb.arcs(spark, sf_dir), 31)
    at = g.arcs.select(F.explode(F.array_distinct(F.array("begin_id", "end_id"))).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return node_labels(g.coverage().where("coverage >= 40")).join(at, "node_id", "left").select("label", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("WITH a AS (SELECT s_name AS name, md5(s_name) AS seq FROM supplier), b AS (SELECT s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN md5(s_name) ELSE md5(s_name || 'x') END AS seq FROM supplier) SELECT count(*) FILTER (a.seq = b.seq) AS same, count(*) FILTER (a.seq <> b.seq) AS different FROM a JOIN b USING (name)")
def fasta_compare(spark, sf_dir):
    from strandflow.operators.validation import compare

    s = tb.table(spark, sf_dir, "supplier")
    return compare(s.select(F.col("s_name").alias("name"), F.md5("s_name").alias("seq")), s.select(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, F.md5("s_name")).otherwise(F.md5(F.concat("s_name", F.lit("x")))).alias("seq")))


@query(f"WITH RECURSIVE {THREADS_SQL}, r AS (SELECT i, s AS node, CAST(0 AS BIGINT) AS d FROM probes UNION SELECT r.i, e.dst, r.d + n.length FROM r JOIN edges e ON e.src = r.node JOIN nodes n ON n.node_id = abs(e.dst) WHERE r.d + n.length <= 120) "
       "SELECT CAST(r.i AS BIGINT) AS p1, CAST(p.i AS BIGINT) AS p2, CAST(min(r.d) AS BIGINT) AS distance FROM r JOIN probes p ON p.s = -r.node AND p.i >= r.i WHERE r.d > 0 GROUP BY ALL")
def wander_distances(spark, sf_dir):
    """All-pairs distances between probes at both ends of each customer's orders, by the wanderer."""
    from strandflow.operators import walkers as wk

    def walk(lg):
        mine = sorted(lg.probes)
        found = wk.wander(lg, [lg.probes[i][0] for i in mine], 120, only=[mine.index(i) for i in lg.asked()])
        return [(mine[a], mine[b], d) for (a, b), d in found.items()]

    return wk.per_component(tb.thread_graph(spark, sf_dir), walk, "p1 long, p2 long, distance long", probes=tb.thread_probes(spark, sf_dir), leash=120)


# A walk may repeat no cycle: what lies between a node and its next return, by its smallest rotation, may not come again behind its end.
@query(f"""WITH RECURSIVE {THREADS_SQL}, live AS (SELECT source AS gap_id, stop, [start] AS path, CAST(0 AS BIGINT) AS bp, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS ends FROM starts JOIN stops USING (source) WHERE start <> stop
  UNION ALL SELECT gap_id, stop, path, bp, CASE WHEN name IS NULL OR known > 0 THEN names ELSE list_append(names, name) END, CASE WHEN name IS NULL OR known > 0 THEN ends ELSE list_append(ends, len(path)) END
    FROM (SELECT *, coalesce(list_position(names, name), 0) AS known FROM (SELECT *, CASE WHEN since IS NOT NULL THEN list_sort(list_transform(range(len(path) - since), lambda r: array_to_string(list_concat(path[since + r:len(path) - 1], path[since:since + r - 1]), ',')))[1] END AS name
      FROM (SELECT l.gap_id, l.stop, list_append(l.path, e.dst) AS path, l.bp + n.length AS bp, l.names, l.ends, CAST(list_max(list_filter(range(1, len(l.path) + 1), lambda j: l.path[j] = e.dst)) AS BIGINT) AS since
        FROM live l JOIN edges e ON e.src = l.path[-1] JOIN nodes n ON n.node_id = abs(e.src) WHERE l.path[-1] <> l.stop AND l.bp + n.length <= 100)))
    WHERE known = 0 OR since < ends[known])
SELECT CAST(gap_id AS BIGINT) AS gap_id, array_to_string(list_transform(path, lambda x: abs(x)), ',') AS path FROM live WHERE path[-1] = stop""")
def cycle_budget_paths(spark, sf_dir):
    """All walks within a leash from each customer's first order to the last that go round no cycle twice."""
    from strandflow.plans import pipelines as pl

    out = pl.gap_paths(tb.thread_graph(spark, sf_dir), tb.thread_pairs(spark, sf_dir).withColumnRenamed("pair_id", "gap_id"), 100, max_paths=None)
    return out.where("path is not null").select("gap_id", tr.ids_only(F.col("path")).alias("path"))


@query(f"WITH r AS (SELECT translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{tb.UPPER}', '{tb.CYCLE}') AS seq FROM conversations), k AS (SELECT DISTINCT substr(seq, CAST(i AS INTEGER), 21) AS m FROM (SELECT seq, unnest(range(1, greatest(length(seq) - 19, 1))) AS i FROM r)) "
       f"SELECT DISTINCT least(m, {_rc('m')}) AS kmer, CAST(1 AS BIGINT) AS n FROM k")
def built_graph_kmers(spark, sf_dir):
    """A graph built from the conversations' sequences holds each of their k-mers exactly once."""
    from strandflow.operators.build import build_graph
    from strandflow.operators.superkmers import counted

    rows = tb.table(spark, sf_dir, "conversations")
    reads = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), tb.UPPER, tb.CYCLE).alias("seq"))
    g = build_graph(reads, 21, track_reads=False)
    paths = g.nodes.select(F.col("node_id").alias("path_id"), F.array("node_id").alias("path"))
    # a node's k-mers need its first k - 1 bases too: they come from the other strand
    short = g.nodes.select("node_id", "length", "ends_fwd", "ends_twin").where("length < 20")
    whole = gr.trail_sequences(paths.join(short.select(F.col("node_id").alias("path_id")), "path_id", "left_anti"), g.nodes, 21)
    few = g.unitigs.join(short.select("node_id"), "node_id", "left_semi")
    return counted(whole.select("seq").unionByName(few.select("seq")), 21)


@query(f"WITH {DNA_SQL}, {_kmers_sql(51, cols='doc_id')} SELECT least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM km GROUP BY ALL")
def long_kmer_counts(spark, sf_dir):
    """Canonical k-mers of 51 bases, counted by minimizers."""
    from strandflow.operators.superkmers import counted

    return counted(tb.dna(spark, sf_dir), 51)


@query()
def assembled_contigs(spark, sf_dir):
    """Contigs of the graph of orders, single-ended."""
    from strandflow.operators import walkers as wk

    out = wk.assembled(tb.thread_graph(spark, sf_dir), wk.AssembleOptions(max_tip_length=20, min_contig_size=0))
    return out.select("shorthand", "fate", F.round("coverage", 6).alias("coverage"))


@query()
def bubbly_contigs(spark, sf_dir):
    """Contigs of the graph of orders that run on through bubbles."""
    from strandflow.operators import walkers as wk

    out = wk.assembled(tb.thread_graph(spark, sf_dir), wk.AssembleOptions(min_contig_size=0), bubbly=True)
    return out.select("shorthand", "fate", F.round("coverage", 6).alias("coverage"))


@query(f"WITH RECURSIVE {THREADS_SQL}, stopped AS (SELECT abs(s) AS id FROM probes), live AS (SELECT i AS probe, [s] AS path, CAST(n.length + 30 AS BIGINT) AS bp, n.length + 30 >= 120 AS over, false AS term FROM probes JOIN nodes n ON n.node_id = abs(s) "
       "UNION ALL SELECT l.probe, list_append(l.path, e.dst), l.bp + n.length, l.bp + n.length >= 120, abs(e.dst) IN (SELECT id FROM stopped) FROM live l JOIN edges e ON e.src = l.path[-1] JOIN nodes n ON n.node_id = abs(e.dst) WHERE NOT l.over AND NOT l.term AND NOT list_contains(l.path, e.dst)), "
       "ended AS (SELECT *, CASE WHEN term THEN 'terminal' WHEN over THEN 'beyond_leash' WHEN NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = path[-1] AND NOT list_contains(path, e.dst)) THEN 'dead_end' END AS fate FROM live) "
       "SELECT CAST(probe AS BIGINT) AS probe, array_to_string(path, ',') AS path, fate FROM ended WHERE fate IS NOT NULL")
def fluffed_paths(spark, sf_dir):
    """All acyclic paths from probes at both ends of each customer's orders, with their fates."""
    from strandflow.operators import walkers as wk

    def walk(lg):
        mine = sorted(lg.probes)
        asked = set(lg.asked())
        return ((i, ",".join(map(str, p)), f) for i, found in zip(mine, wk.fluff(lg, [lg.probes[i][0] for i in mine], 120)) if i in asked for p, f in found)

    return wk.per_component(tb.thread_graph(spark, sf_dir), walk, "probe long, path string, fate string", probes=tb.thread_probes(spark, sf_dir), leash=120)
