"""Consensus of aligned paths and the variants they imply."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.sequence import revcomp
from strandflow.lineage import written

BASES = 1 << 24  # of references that may be broadcast
_KINDS = ["INSERT", "SWAP", "DELETION"]
_TWO_BITS = np.full(128, 4, np.int64)
_TWO_BITS[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_SHORT = 12  # bases of a variant that fit into its code


def _columns(alignments: DataFrame, group: str, aln: str = "aln") -> DataFrame:
    """(group, path_id, col, base): a row for each column of each aligned sequence."""
    return alignments.select(group, "path_id", F.posexplode(F.split(aln, "")).alias("col", "base")).where("base != ''")


def consensus(alignments: DataFrame, group: str) -> DataFrame:
    """(group, consensus): the base all agree on; else '-' where at least half are gaps, and N."""
    c = _columns(alignments, group).groupBy(group, "col").agg(
        F.countDistinct("base").alias("kinds"), F.min("base").alias("base"), F.count("*").alias("n"), F.count_if(F.col("base") == "-").alias("gaps")
    )
    base = F.when(F.col("kinds") == 1, F.col("base")).when(F.col("gaps") * 2 >= F.col("n"), "-").otherwise("N")
    rows = c.select(group, "col", base.alias("b"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "b"))), lambda x: x["b"]), "").alias("consensus"))


def _islands(ref: np.ndarray, alt: np.ndarray):
    """(kind, first, n, pos) of the merged differences of two aligned sequences, and the columns that ``first`` counts, by kind."""
    size = min(len(ref), len(alt))
    ref, alt = ref[:size], alt[:size]
    base = ref != 45
    at = np.flatnonzero(ref != alt)
    kind = np.where(~base[at], 0, np.where(alt[at] == 45, 2, 1))
    order = np.argsort(kind, kind="stable")
    at, kind = at[order], kind[order]
    pos = (np.cumsum(base) - base)[at]
    # insertions stay at one position over consecutive columns, deletions and swaps move on together
    new = np.append(True, (kind[1:] != kind[:-1]) | (pos[1:] - pos[:-1] != (kind[1:] > 0)))[: len(at)]
    first = np.flatnonzero(new)
    return kind[first], first, np.diff(np.append(first, len(at))), pos[first], at


def _coded(most: int = 1 << 22):
    """(group, code, pos, kind, seq, del_len), each once in so many: short variants of A, C, G and T are a code, others are given as they are."""

    def run(batches):
        codes: dict = {}
        other: set = set()
        count, kind_of, name = 0, None, None

        def out():
            rows = [(g, np.unique(np.concatenate(x))) for g, x in codes.items()]
            for g, x in rows:
                for lo in range(0, len(x), 1 << 16):
                    part = pa.array(x[lo : lo + (1 << 16)])
                    yield batch_of([g] * len(part), part, *([None] * len(part) for _ in range(4)))
            if other:
                g, pos, kind, text, size = zip(*other)
                yield batch_of(list(g), pa.nulls(len(g), pa.int64()), list(pos), list(kind), list(text), list(size))

        def batch_of(g, code, pos, kind, text, size):
            columns = [pa.array(g, kind_of), code, pa.array(pos, pa.int32()), pa.array(kind, pa.int32()), pa.array(text, pa.string()), pa.array(size, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, [name, "code", "pos", "kind", "seq", "del_len"])

        for batch in batches:
            kind_of, name = batch.schema.field(0).type, batch.schema.names[0]
            for g, aln, ref in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if not aln.is_valid or not ref.is_valid:
                    continue
                text = aln.as_py()
                alt, ref = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (text, ref.as_py()))
                kind, first, n, pos, at = _islands(ref, alt)
                if not len(first):
                    continue
                two = _TWO_BITS[np.minimum(alt[at], 127)]
                bad = np.append(0, np.cumsum(two > 3))
                short = (pos < 1 << 31) & np.where(kind == 2, n < 1 << 24, (n <= _SHORT) & (bad[first + n] == bad[first]))
                value = np.where(kind == 2, n, 0)
                for j in range(_SHORT):
                    here = (kind < 2) & (j < n) & short
                    if not here.any():
                        break
                    value[here] |= two[first[here] + j] << 2 * j
                size = np.where(kind == 2, 0, n)
                codes.setdefault(g, []).append((pos << 30 | kind << 28 | size << 24 | value)[short])
                for i in np.flatnonzero(~short).tolist():
                    seq = None if kind[i] == 2 else "".join(text[c] for c in at[first[i] : first[i] + n[i]].tolist())
                    other.add((g, int(pos[i]), int(kind[i]), seq, int(n[i]) if kind[i] == 2 else None))
                count += len(first)
                if count >= most:
                    codes = {x: [np.unique(np.concatenate(y))] for x, y in codes.items()}
                    count = sum(len(y[0]) for y in codes.values()) + len(other)
                    if count >= most // 2:
                        yield from out()
                        codes, other, count = {}, set(), 0
        if codes or other:
            yield from out()

    return run


def _decoded(batches):
    """(group, pos, type, seq, del_len) of what ``_coded`` gives."""
    bases = np.frombuffer(b"ACGT", np.uint8)
    for batch in batches:
        name = batch.schema.names[0]
        given = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        code = batch.column(1).fill_null(0).to_numpy()
        pos, kind, size, value = code >> 30, code >> 28 & 3, code >> 24 & 15, code & (1 << 24) - 1
        letters = bases[value[:, None] >> 2 * np.arange(_SHORT) & 3].tobytes().decode()
        seqs = [letters[_SHORT * i : _SHORT * i + n] for i, n in enumerate(size.tolist())]
        old = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
        kinds, which = [k if g else o for k, g, o in zip(kind.tolist(), given, old[1])], given.tolist()
        columns = [
            batch.column(0), pa.array([p if g else o for p, g, o in zip(pos.tolist(), which, old[0])], pa.int32()), pa.array([_KINDS[k] for k in kinds]),
            pa.array([(s if k != 2 else None) if g else o for s, k, g, o in zip(seqs, kinds, which, old[2])], pa.string()),
            pa.array([(v if k == 2 else None) if g else o for v, k, g, o in zip(value.tolist(), kinds, which, old[3])], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [name, "pos", "type", "seq", "del_len"])


def variants(reference: DataFrame, alternates: DataFrame, group: str) -> DataFrame:
    """(group, pos, type, seq, del_len): differences of aligned alternates (group, path_id, aln) from the aligned reference (group, aln), merged
    where they touch and given once. Positions count the reference's bases from 0. Each alternate meets its whole reference in one task, which gives what differs; only
    that is shuffled, each variant once a task."""
    ref = written(reference.select(group, F.col("aln").alias("_ref")), "variant-references")
    few = (ref.agg(F.sum(F.length("_ref"))).first()[0] or 0) <= BASES
    rows = alternates.select(group, "aln").join(F.broadcast(ref) if few else ref, group)
    kind = rows.schema[group].dataType.simpleString()
    found = rows.mapInArrow(_coded(), f"`{group}` {kind}, code long, pos int, kind int, seq string, del_len int").distinct()
    return found.mapInArrow(_decoded, f"`{group}` {kind}, pos int, type string, seq string, del_len int")


def shorthand(v: DataFrame) -> DataFrame:
    """``text``: '27S:ATG', '36D:1', '5I:AC'."""
    return v.withColumn("text", F.concat(F.col("pos").cast("string"), F.substring("type", 1, 1), F.lit(":"), F.coalesce("seq", F.col("del_len").cast("string"))))


def reversed_variants(v: DataFrame, length: str) -> DataFrame:
    """The variants on the other strand of a reference of ``length`` bases."""
    span = F.when(F.col("type") == "DELETION", F.col("del_len")).when(F.col("type") == "SWAP", F.length("seq")).otherwise(0)
    return v.withColumn("pos", F.col(length) - F.col("pos") - span).withColumn("seq", revcomp(F.col("seq")))


def vcf_rows(v: DataFrame, name: str, ref_seq: str) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO: positions from 1; insertions and deletions carry the base before them."""
    at = lambda p, n: F.substr(F.col(ref_seq), p, n)
    one = F.lit(1)
    pos = F.when(F.col("type") == "SWAP", F.col("pos") + 1).otherwise(F.col("pos"))
    anchor = F.when(F.col("pos") > 0, at(F.col("pos"), one)).otherwise("")
    ref = F.when(F.col("type") == "SWAP", at(F.col("pos") + 1, F.length("seq"))).when(F.col("type") == "INSERT", anchor).otherwise(F.concat(anchor, at(F.col("pos") + 1, F.col("del_len"))))
    alt = F.when(F.col("type") == "SWAP", F.col("seq")).when(F.col("type") == "INSERT", F.concat(anchor, F.col("seq"))).otherwise(anchor)
    return v.select(
        F.col(name).alias("CHROM"), pos.cast("int").alias("POS"), F.lit(".").alias("ID"), ref.alias("REF"), alt.alias("ALT"), F.lit("20").alias("QUAL"),
        F.lit("PASS").alias("FILTER"), F.lit("strandflow").alias("INFO"),
    )


def vcf_rows_over(v: DataFrame, references: DataFrame, name: str, ref_seq: str, piece: int = 1024) -> DataFrame:
    """``vcf_rows`` where references (name, ref_seq) are long: variants meet the pieces of them that they touch, never a whole one."""
    n = F.length(ref_seq)
    cuts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / piece))).otherwise(F.array().cast("array<bigint>"))
    pieces = references.select(F.col(name).alias("_n"), ref_seq, F.explode(cuts).alias("_no")).select("_n", "_no", F.expr(f"substr({ref_seq}, cast(_no * {piece} + 1 as int), {piece})").alias("_piece"))
    first = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / piece)
    last = F.floor((F.col("pos") + F.greatest(F.coalesce("del_len", F.lit(0)), F.coalesce(F.length("seq"), F.lit(0)))) / piece)
    rows = v.withColumn("_key", F.struct(name, "pos", "type", "seq", "del_len")).select("_key", F.col(name).alias("_n"), first.alias("_first"), F.explode(F.sequence(first, last)).alias("_no"))
    near = rows.join(pieces, ["_n", "_no"], "left").groupBy("_key").agg(
        F.min("_first").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", F.coalesce("_piece", F.lit("")).alias("p")))), lambda x: x["p"]), "").alias("_ref")
    )
    near = near.select("_key.*", "_ref", (F.col("_first") * piece).alias("_begin"))
    near = near.withColumn("pos", F.col("pos") - F.col("_begin")).withColumn("_named", F.struct(F.col(name).alias("n"), F.col("_begin").alias("b")))
    out = vcf_rows(near, "_named", "_ref")
    return out.withColumn("POS", (F.col("POS") + F.col("CHROM.b")).cast("int")).withColumn("CHROM", F.col("CHROM.n"))
