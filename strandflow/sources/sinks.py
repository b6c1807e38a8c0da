"""What results are written as: FASTA, VCF, tables, graph drawings, nested text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.sequence import wrapped
from strandflow.functions.trails import oriented


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq", width: int | None = None) -> DataFrame:
    """``value``: a record for each row, its sequence in lines of ``width`` or in one."""
    body = wrapped(F.col(seq), width) if width else F.col(seq)
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, order: list[str], name: str = "name", seq: str = "seq", width: int | None = None) -> None:
    """Sorted records as text; ranges of the order keep it over many files."""
    rows = df.select(*order, name, seq) if name not in order and seq not in order else df
    fasta_lines(rows.sort(*order), name, seq, width).write.text(path)


def write_vcf(rows: DataFrame, path: str) -> None:
    """A header and tab-separated rows, sorted by sequence and position."""
    head = rows.sparkSession.createDataFrame([("#" + "\t".join(rows.columns),)], "value string")
    body = rows.sort("CHROM", "POS").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))
    head.union(body).write.text(path)


def connection_lines(named: DataFrame) -> DataFrame:
    """``value``: name:side, name:side and distance, tab-separated."""
    return named.select(F.concat_ws("\t", F.concat_ws(":", "name1", "side1"), F.concat_ws(":", "name2", "side2"), F.col("distance").cast("string")).alias("value"))


def contig_stats(contigs: DataFrame) -> DataFrame:
    return contigs.select("name", F.length("seq").alias("length"), "coverage")


def nested_lines(contigs: DataFrame) -> DataFrame:
    """``value``: a JSON object for each contig (name, nested): its parts, regular nodes or bubbles with their steps and nodes, and their coverages."""
    name = F.regexp_replace(F.to_json(F.struct(F.col("name").alias("contig_name"))), r"\}$", "")
    return contigs.select(F.concat(name, F.lit(',"graph":'), "nested", F.lit("}")).alias("value"))


def output_folder(spark: SparkSession, path: str) -> str:
    """``path`` as a folder for results: made where it doesn't exist; a file or a folder with something in it raises before any work is done."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        if not fs.getFileStatus(where).isDirectory():
            raise NotADirectoryError(path)
        if len(fs.listStatus(where)):
            raise FileExistsError(f"{path} isn't empty")
    elif not fs.mkdirs(where):
        raise PermissionError(path)
    return path


def node_labels(nodes: DataFrame) -> DataFrame:
    """``label``: n{id}_length{length}_coverage{rounded}."""
    return nodes.withColumn("label", F.concat(F.lit("n"), F.col("node_id").cast("string"), F.lit("_length"), F.col("length").cast("string"), F.lit("_coverage"), F.round("coverage").cast("long").cast("string")))


def dot_lines(graph, starts: DataFrame | list[int] = (), ends: DataFrame | list[int] = (), paired: DataFrame | None = None, min_coverage: float = 0.0, nicknames: DataFrame | None = None) -> DataFrame:
    """(ord, value): the lines of a Graphviz drawing. Start nodes are red, end nodes green; arrow shapes tell how an arc leaves and enters; pairs
    that no arc joins are dashed grey lines, each once. Starts and ends are lists, or tables (node_id)."""
    shown = node_labels(graph.coverage().where(F.col("coverage") >= min_coverage))
    label = F.col("label")
    if nicknames is not None:
        shown = shown.join(nicknames, "node_id", "left")
        label = F.concat(label, F.coalesce(F.concat(F.lit(" "), F.col("nickname")), F.lit("")))
    spark = graph.nodes.sparkSession
    for marked, name in ((starts, "_start"), (ends, "_end")):
        ids = marked if isinstance(marked, DataFrame) else spark.createDataFrame([(int(n),) for n in marked], "node_id int")
        shown = shown.join(ids.select("node_id").distinct().withColumn(name, F.lit(True)), "node_id", "left")
    color = F.when(F.col("_start"), ', color="red"').when(F.col("_end"), ', color="green"').otherwise("")
    nodes = shown.select(F.lit(1).alias("ord"), F.format_string('  n%d [label="%s"%s];', "node_id", label, color).alias("value"))
    kept = shown.select("node_id")
    both = lambda df, a, b: df.join(kept.withColumnRenamed("node_id", a), a, "left_semi").join(kept.withColumnRenamed("node_id", b), b, "left_semi")
    tail = F.when(F.col("begin_fwd"), "none").otherwise("inv")
    head = F.when(F.col("end_fwd"), "normal").otherwise("inv")
    arcs = both(graph.arcs, "begin_id", "end_id").select(F.lit(2).alias("ord"), F.format_string("  n%d -> n%d [arrowtail=%s, arrowhead=%s];", "begin_id", "end_id", tail, head).alias("value"))
    out = nodes.unionByName(arcs)
    if paired is not None:
        pair = paired.select(F.least(F.abs("src"), F.abs("dst")).alias("a"), F.greatest(F.abs("src"), F.abs("dst")).alias("b")).distinct()
        direct = graph.arcs.select(F.least("begin_id", "end_id").alias("a"), F.greatest("begin_id", "end_id").alias("b")).distinct()
        lines = both(pair.join(direct, ["a", "b"], "left_anti"), "a", "b").select(F.lit(3).alias("ord"), F.format_string("  n%d -> n%d [style=dashed, color=grey, dir=none];", "a", "b").alias("value"))
        out = out.unionByName(lines)
    return spark.createDataFrame([(0, "digraph G {")], "ord int, value string").unionByName(out).unionByName(spark.createDataFrame([(4, "}")], "ord int, value string"))


def signed_probes(found: DataFrame) -> DataFrame:
    return found.select("probe_idx", oriented(F.col("node_id"), F.col("fwd")).alias("node"))
