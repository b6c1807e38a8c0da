"""k-mers of at most 31 bases as 64-bit integers, two bits a base (A, C, G, T are 0 to 3, so integers order as texts do)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 31
DENSE = 12  # of so many bases all k-mers are few enough to have a place each: 4^12 bits are 2 MB
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_TURNED = str.maketrans("ACGT", "TGCA")


def pack(kmer: Column) -> Column:
    """The integer of a k-mer of A, C, G and T."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def codes_of(seqs: list[bytes], k: int, both_strands: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(text number, position, code) of the k-mers of A, C, G and T, and (text number, position) of those with other characters."""
    lens = np.array([len(s) for s in seqs])
    base = _CODE[np.frombuffer(b"".join(seqs), np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), []
    fwd, rev, pure = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        b = base[j : j + n]
        pure &= b < 4
        b = (b & 3).astype(np.int64)
        fwd = fwd << 2 | b
        if both_strands:
            rev |= (3 - b) << 2 * j
    of = np.repeat(np.arange(len(seqs)), lens)
    pos = np.arange(len(base)) - np.repeat(np.cumsum(lens) - lens, lens)
    of, pos = of[:n], pos[:n]
    whole = pos + k <= lens[of]
    at = np.flatnonzero(whole & pure)
    code = np.minimum(fwd[at], rev[at]) if both_strands else fwd[at]
    odd = np.flatnonzero(whole & ~pure)
    return of[at], pos[at], code, list(zip(of[odd].tolist(), pos[odd].tolist()))


def _counted(k: int, both_strands: bool, names: list[str], bases: int = 1 << 22):
    def dense(batches):
        """The same without names, where each k-mer has a place: one table a task, and only odd k-mers by text."""
        n, other = np.zeros(4**k, np.int64), {}
        for batch in batches:
            texts, size = [], 0
            for i in range(batch.num_rows + 1):
                text = (batch.column(0)[i].as_py() or "").encode() if i < batch.num_rows else b""
                if texts and (i == batch.num_rows or size + len(text) > bases >> 2):
                    _, _, code, odd = codes_of(texts, k, both_strands)
                    n += np.bincount(code, minlength=len(n))
                    for at, p in odd:
                        w = texts[at][p : p + k].decode()
                        w = min(w, w.upper().translate(_TURNED)[::-1]) if both_strands else w
                        other[w] = other.get(w, 0) + 1
                    texts, size = [], 0
                texts.append(text)
                size += len(text)
        found = np.flatnonzero(n)
        for lo in range(0, len(found), 1 << 16):
            part = found[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.string()), pa.array(n[part])], ["code", "text", "n"])
        if other:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(other), pa.int64()), pa.array(list(other)), pa.array(list(other.values()), pa.int64())], ["code", "text", "n"])

    def run(batches):
        if not names and k <= DENSE:
            yield from dense(batches)
            return
        for batch in batches:
            size, start = 0, 0
            lens = [len(x) if x is not None else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
            for i, n in enumerate([*lens, None]):
                if n is not None and (size + n <= bases or i == start):
                    size += n
                    continue
                if i > start:
                    yield counted(batch.slice(start, i - start))
                start, size = i, n or 0

    def counted(part):
        texts = [(t or "").encode() for t in part.column(part.num_columns - 1).to_pylist()]
        of, _, code, odd = codes_of(texts, k, both_strands)
        group = np.zeros(part.num_rows, np.int64)
        first = np.zeros(min(1, part.num_rows), np.int64)
        if names:  # rows of equal values count together
            keys: dict = {}
            rows = zip(*(part.column(i).to_pylist() for i in range(len(names))))
            group = np.array([keys.setdefault(r, len(keys)) for r in rows], np.int64)
            _, first = np.unique(group, return_index=True)
        if len(group) and int(group.max()) < 1 << 62 - 2 * k:
            both = np.sort(group[of] << 2 * k | code)
            g, c = both >> 2 * k, both & (1 << 2 * k) - 1
        else:
            order = np.lexsort([code, group[of]])
            g, c = group[of][order], code[order]
        cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))) if len(c) else np.empty(0, int)
        n = np.diff(np.append(cut, len(c)))
        other: dict = {}
        for i, p in odd:
            w = texts[i][p : p + k].decode()
            if both_strands:
                w = min(w, w.upper().translate(_TURNED)[::-1])
            other[int(group[i]), w] = other.get((int(group[i]), w), 0) + 1
        at = pa.array(first[np.concatenate([g[cut], np.array([x for x, _ in other], np.int64)])] if len(cut) or other else np.empty(0, np.int64))
        columns = [part.column(i).take(at) for i in range(len(names))]
        columns += [pa.concat_arrays([pa.array(c[cut], pa.int64()), pa.nulls(len(other), pa.int64())]), pa.concat_arrays([pa.nulls(len(cut), pa.string()), pa.array([w for _, w in other], pa.string())])]
        columns += [pa.array(np.concatenate([n, np.array([*other.values()], np.int64)]), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*names, "code", "text", "n"])

    return run


def counted_kmers(seqs: DataFrame, k: int, by: list[str], seq: str = "seq", both_strands: bool = True) -> DataFrame:
    """(by..., code, text, n): k-mers counted within batches. ``code`` is for those of A, C, G and T, ``text`` for others; on both strands the smaller of
    the two readings counts. ASCII only."""
    if not 0 < k <= LONGEST:
        raise ValueError(f"packed k-mers have 1 to {LONGEST} bases")
    rows = seqs.select(*by, seq)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(by)])
    return rows.mapInArrow(_counted(k, both_strands, list(by)), (kept + ", " if kept else "") + "code long, text string, n long")
