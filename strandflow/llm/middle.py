"""Fill-in-middle transformation, cut by succinct rank and select.

The texts of a batch lie one behind the other as UTF-8 bytes with two packed bitvectors over them: where units begin (a run of ASCII letters, or any
other character) and where characters begin. Each has a directory of ones before every block of ``BLOCK`` bits. A text's units are the ones
between its ends (rank); a cut after m units is the place of the one with that rank (select: the directory gives the block, popcounts and one unpacked block the place);
lengths in characters are ranks again. Texts are cut as bytes and never decoded. Bitvectors are filled in pieces, and a batch is worked in chunks, so beside the
texts a task holds a fourth of their size and the pieces.

Cuts and form follow from the hex SHA-256 of ``1:`` and the decimal id, so they don't depend on order, partitions or the run. Text between the marks of an output can't form a
mark with them (a mark holds no mark's beginning but its own), so splitting an output at its marks gives back the parts.

Defined results: null text is empty; empty texts are plain; rows without an id are cut by the hash of ``1:``; repeated rows and ids are rows of their
own; an empty table gives no rows; of other columns those named in ``carry`` ride along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

BLOCK = 512  # bits of a directory entry
MARKS = ("<P>", "<S>", "<M>")  # ahead of prefix, suffix and middle
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Bits:
    """A packed bitvector with rank and select over a directory of ones before each block."""

    def __init__(self, size: int):
        self.packed = np.zeros(-(-size // BLOCK) * (BLOCK // 8), np.uint8)

    def put(self, start: int, flags: np.ndarray) -> None:
        """Sets flags from ``start`` on, a multiple of 8."""
        some = np.packbits(flags)
        self.packed[start // 8 : start // 8 + len(some)] = some

    def close(self) -> Bits:
        ones = _ONES[self.packed].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        return self

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = np.minimum(at // BLOCK, len(self.before) - 1)
        out = self.before[block]
        inside = np.flatnonzero(at % BLOCK)
        bits = np.unpackbits(self.packed.reshape(-1, BLOCK // 8)[block[inside]], axis=1)
        out[inside] += (bits * (np.arange(BLOCK) < (at[inside] % BLOCK)[:, None])).sum(axis=1, dtype=np.int64)
        return out

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Places of the ones with these ranks, from 0."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        seen = np.cumsum(np.unpackbits(self.packed.reshape(-1, BLOCK // 8)[block], axis=1), axis=1, dtype=np.int16)
        return block * BLOCK + (seen <= (nth - self.before[block])[:, None]).sum(axis=1)


def boundaries(data: np.ndarray, starts: np.ndarray, piece: int = 1 << 20) -> tuple[Bits, Bits]:
    """(units, characters) that begin at each byte of texts that begin at ``starts``. ``piece`` is a multiple of 8."""
    units, chars = Bits(len(data)), Bits(len(data))
    for lo in range(0, len(data), piece):
        x = data[lo : lo + piece]
        first = (x & 0xC0) != 0x80
        letter = ((x | 0x20) >= 97) & ((x | 0x20) <= 122)
        last = data[lo - 1] if lo else 0
        behind = np.concatenate([[97 <= (last | 0x20) <= 122], letter[:-1]])  # the byte ahead is a letter ...
        behind[starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + len(x))] - lo] = False  # ... of the same text
        units.put(lo, first & ~(letter & behind))
        chars.put(lo, first)
    return units.close(), chars.close()


def _select_many(bits: Bits, nth: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([bits.select(nth[i : i + rows]) for i in range(0, len(nth), rows)]) if len(nth) else nth


def _cut(plain_share: int, spm_share: int, chunk: int):
    p, s, m = (x.encode() for x in MARKS)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(1).cast(pa.large_binary())
        h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + batch.num_rows + 1]
        lo = int(ends[0])
        whole = text.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[lo : int(ends[-1])] if whole is not None else np.empty(0, np.uint8)
        ends = ends - lo
        units, chars = boundaries(data, ends[:-1])
        ahead = units.rank(ends)
        n = np.diff(ahead)
        one, two = h1 % (n + 1), h2 % (n + 1)

        def place(after):  # the byte at which the unit after so many begins
            at = ends[1:].copy()
            inner = np.flatnonzero(after < n)
            at[inner] = _select_many(units, (ahead[:-1] + after)[inner])
            return at

        a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
        ca, cb, c0 = chars.rank(a), chars.rank(b), chars.rank(ends[:-1])
        forms, outs, pre, mid = [], [], [], []
        raw = memoryview(data)
        for i in range(batch.num_rows):
            t = bytes(raw[ends[i] : ends[i + 1]])
            if not t or h3[i] % 100 >= plain_share or p in t or s in t or m in t:
                forms.append("plain")
                outs.append(t)
                pre.append(None)
                mid.append(None)
                continue
            x, y = int(a[i] - ends[i]), int(b[i] - ends[i])
            spm = h4[i] % 100 < spm_share
            forms.append("spm" if spm else "psm")
            outs.append(b"".join([s, t[y:], p, t[:x], m, t[x:y]] if spm else [p, t[:x], s, t[y:], m, t[x:y]]))
            pre.append(int(ca[i] - c0[i]))
            mid.append(int(cb[i] - ca[i]))
        columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(outs, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["carried", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches):
        for batch in batches:
            size = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # so many bytes, or one text
                base = size[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(size, base + chunk, side="right")))
                yield some(batch.slice(at, stop - at))
                at = stop

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ("doc_id",), plain_share: int = 90, spm_share: int = 20, chunk: int = 1 << 23
) -> DataFrame:
    """(carried, n, form, prefix_chars, middle_chars, output): each text as plain, psm or spm, with the columns named in ``carry`` as a struct. A text is
    transformed where h3 % 100 is below ``plain_share``, as spm where h4 % 100 is below ``spm_share``."""
    text_batches(docs.sparkSession, 64)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.struct(*carry).alias("carried"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *parts)
    kept = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(_cut(plain_share, spm_share, chunk), f"carried {kept}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    from_, upto = (lambda x, mark: F.substring_index(x, mark, -1)), (lambda x, mark: F.substring_index(x, mark, 1))
    p, s, m = MARKS
    ahead, middle = upto(output, m), from_(output, m)  # the marks and the parts ahead of the middle
    psm = F.concat(from_(upto(ahead, s), p), middle, from_(ahead, s))
    spm = F.concat(from_(ahead, p), middle, from_(upto(ahead, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    again = restored(F.col("output"), F.col("form"))
    return out.select("carried.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || substr(d, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS hs FROM h),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS a, greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
