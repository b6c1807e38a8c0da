"""Nucleotide sequences as column expressions; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard genetic code, fixed values: bases in the order T, C, A, G for each position; * is stop
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ("ATG",)
STOP_CODONS = ("TAA", "TAG", "TGA")


def revcomp(seq: Column) -> Column:
    """Reverse complement, upper case; characters other than ACGT stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def revcomp_sql(seq: str) -> str:
    return f"reverse(translate(upper({seq}), 'ACGT', 'TGCA'))"


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def with_kmers(df: DataFrame, seq: str, k: int, name: str = "kmer", position: str = "pos", piece: int = 512) -> DataFrame:
    """A row for each k-mer of column ``seq``, which it replaces, with its 0-based position; shorter sequences give none.

    Long sequences are cut into overlapping pieces first: a substring of a string column costs its distance from the start."""
    keep = [c for c in df.columns if c != seq]
    n = F.length(seq) - k + 1
    cuts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(piece))).otherwise(F.array().cast("array<int>"))
    pieces = df.select(*keep, seq, F.explode(cuts).alias("_at")).select(*keep, "_at", F.expr(f"substr({seq}, _at + 1, {piece + k - 1})").alias("_piece"))
    words = F.expr(f"transform(sequence(1, length(_piece) - {k - 1}), i -> substr(_piece, i, {k}))")
    rows = pieces.select(*keep, "_at", F.posexplode(words).alias("_in", name))
    return rows.select(*keep, (F.col("_at") + F.col("_in")).alias(position), name)


def wrapped(seq: Column, width: int = 80) -> Column:
    """``seq`` in lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def codon_table() -> dict[str, str]:
    """Amino acid by codon, built from the standard code."""
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return dict(zip(codons, AMINO_ACIDS))


def translate_codons(seq: Column) -> Column:
    """Protein of whole codons, '*' for stops; raises where a codon has other characters than ACGT."""
    table = codon_table()
    keys = F.array(*[F.lit(k) for k in table])
    values = F.array(*[F.lit(v) for v in table.values()])
    lookup = F.map_from_arrays(keys, values)
    starts = F.when(F.length(seq) >= 3, F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))

    def amino(i):
        codon = F.upper(F.substr(seq, i, F.lit(3)))
        return F.coalesce(lookup[codon], F.raise_error(F.concat(F.lit("not a codon: "), codon)).cast("string"))

    return F.array_join(F.transform(starts, amino), "")
