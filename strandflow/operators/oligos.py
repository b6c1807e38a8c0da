"""Short oligos by melting temperature, with the nearest-neighbour model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unified nearest-neighbour parameters (kcal/mol and cal/(mol K)), published values
ENTHALPY = {"AA": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "GT": -8.4, "CT": -7.8, "GA": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0}
ENTROPY = {"AA": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "GT": -22.4, "CT": -21.0, "GA": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9}
_TURN = str.maketrans("ACGT", "TGCA")


def _both(table: dict[str, float]) -> dict[str, float]:
    return {**table, **{k.translate(_TURN)[::-1]: v for k, v in table.items()}}


def melting_temperature(seq: Column, dna_nm: float = 50.0, salt_mm: float = 50.0) -> Column:
    """Degrees Celsius at the given concentrations."""
    def total(table):
        lookup = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))
        return F.aggregate(F.sequence(F.lit(1), F.length(seq) - 1), F.lit(0.0), lambda a, i: a + F.coalesce(lookup[F.substr(seq, i, F.lit(2))], F.lit(0.0)))

    ends = F.transform(F.array(F.left(seq, F.lit(1)), F.right(seq, F.lit(1))), lambda c: c.isin("A", "T"))
    at_ends = F.size(F.filter(ends, lambda x: x))
    h = total(_both(ENTHALPY)) + 2.3 * at_ends + 0.1 * (2 - at_ends)
    s = total(_both(ENTROPY)) + 4.1 * at_ends - 2.8 * (2 - at_ends) + 0.368 * (F.length(seq) - 1) * F.log(F.lit(salt_mm / 1000))
    return F.lit(1000.0) * h / (s + 1.987 * F.log(F.lit(dna_nm / 4e9))) - 273.15


def candidates(seqs: DataFrame, lowest: float, best: float, highest: float, gc_clamp: int = 0, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(seq_id, oligo, tm): prefixes within the temperatures whose last ``gc_clamp`` bases are G or C, by distance from ``best``."""
    rows = seqs.select(seq_id, F.explode(F.expr(f"transform(sequence(2, greatest(length({seq}), 2)), n -> left({seq}, n))")).alias("oligo")).where("length(oligo) >= 2")
    rows = rows.withColumn("tm", melting_temperature(F.col("oligo"))).where(F.col("tm").between(lowest, highest))
    if gc_clamp:
        rows = rows.where(F.regexp_like("oligo", F.lit(f"[GC]{{{gc_clamp}}}$")))
    return rows.withColumn("off", F.abs(F.col("tm") - best))


def just_below(seqs: DataFrame, highest: float, gc_clamp: int = 0, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(seq_id, oligo, tm): the longest prefix of each sequence that melts at ``highest`` or below."""
    rows = candidates(seqs, -1000.0, highest, highest, gc_clamp, seq_id, seq)
    return rows.groupBy(seq_id).agg(F.max_by(F.struct("oligo", "tm"), F.length("oligo")).alias("b")).select(seq_id, "b.*")
