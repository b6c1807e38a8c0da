"""FASTA and FASTQ files, plain or gzipped, as tables of reads."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.lineage import global_rank


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, name, seq): name is the whole header, seq its lines joined. Records begin at lines that begin with '>'. Files are split between
    records; gzip files can't be."""
    text = spark.read.option("lineSep", "\n>").text(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"))
    text = text.withColumn("value", F.when(F.col("_b") == 0, F.regexp_replace("value", "^>", "")).otherwise(F.col("value")))
    rows = text.where(F.trim("value") != "").withColumn("_p", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)")
    return rows.select("file", F.struct("_b", "_p").alias("pos"), F.rtrim(F.regexp_replace(head, "\r$", "")).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, name, seq, qual) of four-line records. Files are split at any line: lines are numbered by one range-partitioned sort, and four make a record."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_p"))
    lines = global_rank(lines, ["file", "_b", "_p"], "fastq-lines", "line")
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    lines = lines.join(F.broadcast(first), "file").withColumn("i", F.col("line") - F.col("first"))  # a row for each file
    rows = lines.groupBy("file", F.floor(F.col("i") / 4).alias("r")).agg(*[F.max(F.when(F.col("i") % 4 == n, F.regexp_replace("value", "\r$", ""))).alias(c) for n, c in ((0, "h"), (1, "seq"), (3, "qual"))])
    rows = rows.where("h like '@%'")
    return rows.select("file", F.struct(F.lit(0).cast("long").alias("_b"), F.col("r").alias("_p")).alias("pos"), F.expr("substr(h, 2)").alias("name"), "seq", "qual")


@dataclass
class ReadInput:
    """Lists of files by layout, format and compression, as on a command line."""

    fasta_singles: list[str] = field(default_factory=list)
    fastq_singles: list[str] = field(default_factory=list)
    fasta_singles_gz: list[str] = field(default_factory=list)
    fastq_singles_gz: list[str] = field(default_factory=list)
    interleaved_fasta: list[str] = field(default_factory=list)
    interleaved_fastq: list[str] = field(default_factory=list)
    interleaved_fasta_gz: list[str] = field(default_factory=list)
    interleaved_fastq_gz: list[str] = field(default_factory=list)
    separate_fasta: list[str] = field(default_factory=list)
    separate_fastq: list[str] = field(default_factory=list)
    separate_fasta_gz: list[str] = field(default_factory=list)
    separate_fastq_gz: list[str] = field(default_factory=list)

    def validate(self, previous_assembly: str | None = None) -> str | None:
        """What is wrong, or None: some input is needed unless an assembly is reused; separate files come in twos."""
        if previous_assembly is None and not any(getattr(self, f.name) for f in fields(self)):
            return "no sequence input was given"
        for f in fields(self):
            if f.name.startswith("separate") and len(getattr(self, f.name)) % 2:
                return f"{f.name} must list pairs of files"
        return None

    def reads(self, spark: SparkSession, first_id: int = 1) -> DataFrame:
        """(read_id, name, seq, category, pair_id): singles first, then interleaved and separate pairs, in the order given; mates have consecutive ids."""
        if error := self.validate():
            raise ValueError(error)
        parts = []
        for f in fields(self):
            layout = next(x for x in ("single", "interleaved", "separate") if x in f.name)
            read = read_fastq if "fastq" in f.name else read_fasta
            files = getattr(self, f.name)
            for n, path in enumerate(files):
                rows = global_rank(read(spark, path).select("pos", "name", "seq"), ["pos"], "reads-rank").select("rank", "name", "seq")
                order = {"single": 0, "interleaved": 1, "separate": 2}[layout]
                if layout == "separate":
                    key = [F.lit(n // 2).alias("file"), F.col("rank").alias("i"), F.lit(n % 2).alias("mate")]
                elif layout == "interleaved":
                    key = [F.lit(n).alias("file"), F.floor(F.col("rank") / 2).alias("i"), (F.col("rank") % 2).cast("int").alias("mate")]
                else:
                    key = [F.lit(n).alias("file"), F.col("rank").alias("i"), F.lit(0).alias("mate")]
                parts.append(rows.select(F.lit(order).alias("o"), F.lit(f.name).alias("category"), *key, "name", "seq"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = global_rank(out, ["o", "category", "file", "i", "mate"], "reads-ids")
        read_id = F.col("rank") + first_id
        pair = F.when(F.col("o") > 0, F.when(F.col("mate") == 0, read_id + 1).otherwise(read_id - 1))
        return out.select(read_id.alias("read_id"), "name", "seq", "category", pair.alias("pair_id"))


def read_list(spark: SparkSession, path: str, numbers: bool = False) -> DataFrame:
    """(value): one entry a line, its first word; with ``numbers`` anything but whole numbers raises."""
    word = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    rows = spark.read.text(path).where(F.trim("value") != "")
    if not numbers:
        return rows.select(word.alias("value"))
    return rows.select(F.when(F.regexp_like(F.trim("value"), F.lit("^[0-9]+$")), word.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), F.col("value"))).cast("long")).alias("value"))


def read_abundances(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, counts) from lines 'kmer c1 c2 ...'; lines of another width or k raise."""
    parts = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.upper(parts[0]).alias("kmer"), F.expr("transform(slice(split(trim(value), ' +'), 2, size(split(trim(value), ' +'))), x -> cast(x as bigint))").alias("counts"))
    shape = rows.agg(F.countDistinct(F.length("kmer"), F.size("counts"))).first()[0]
    if shape > 1:
        raise ValueError("k-mers or counts of different sizes")
    return rows
