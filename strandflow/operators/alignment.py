"""Global alignment of a few sequences, such as the paths that could fill one gap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CELLS = 1 << 24  # of one alignment table; longer pairs are cut at shared unique words first


def _table(a: str, b: str, match: int, mismatch: int, gap: int) -> list[tuple[int, int]]:
    """Columns (index in a or -1, index in b or -1) of a best alignment; a row of the table at a time."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    steps = np.arange(len(y) + 1) * gap
    row, moves = steps.astype(np.int64), np.zeros((len(x) + 1, len(y) + 1), np.uint8)
    moves[0, 1:], moves[1:, 0] = 2, 1
    for i in range(1, len(x) + 1):
        down = row + gap
        across = row[:-1] + np.where(y == x[i - 1], match, mismatch)
        best = down.copy()
        best[1:] = np.maximum(down[1:], across)
        new = np.maximum.accumulate(best - steps) + steps  # gaps in a run on along the row
        moves[i, 1:] = np.where(new[1:] == across, 0, np.where(new[1:] == down[1:], 1, 2))
        row = new
    out, i, j = [], len(x), len(y)
    while i or j:
        m = moves[i, j] if i and j else 1 if i else 2
        i, j = i - (m != 2), j - (m != 1)
        out.append((i if m != 2 else -1, j if m != 1 else -1))
    return out[::-1]


def _anchors(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Words that stand once in each, in an order that both share (a longest one)."""
    once = []
    for s in (a, b):
        seen: dict[str, int] = {}
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            seen[w] = -1 if w in seen else i
        once.append({w: i for w, i in seen.items() if i >= 0})
    pairs = sorted((i, once[1][w]) for w, i in once[0].items() if w in once[1])
    tops: list[int] = []
    ends: list[int] = []
    back = []
    for n, (_, j) in enumerate(pairs):
        at = int(np.searchsorted(ends, j)) if ends else 0
        back.append(tops[at - 1] if at else -1)
        ends[at : at + 1], tops[at : at + 1] = [j], [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align_two(a: str, b: str, match: int = 2, mismatch: int = -3, gap: int = -4, word: int = 24) -> list[tuple[int, int]]:
    """Columns (index in a or -1, index in b or -1) of a global alignment: equal ends are laid side by side, then long middles are cut at
    shared unique words, ever shorter ones, until a table fits."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head = [(i, i) for i in range(lo)]
    tail = [(len(a) - hi + i, len(b) - hi + i) for i in range(hi)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y or (len(x) + 1) * (len(y) + 1) <= CELLS:
        middle = [(i, -1) for i in range(len(x))] + [(-1, j) for j in range(len(y))] if not x or not y else _table(x, y, match, mismatch, gap)
    else:
        cuts = _anchors(x, y, word) if word >= 6 else [(len(x) // 2, len(y) // 2)]  # nothing in common: cut in the middle
        middle, i0, j0 = [], 0, 0
        for i, j in [*cuts, (len(x), len(y))]:
            part = align_two(x[i0:i], y[j0:j], match, mismatch, gap, word if cuts else word // 2)
            middle += [(p + i0 if p >= 0 else -1, q + j0 if q >= 0 else -1) for p, q in part]
            i0, j0 = i, j
    return head + [(p + lo if p >= 0 else -1, q + lo if q >= 0 else -1) for p, q in middle] + tail


def align_all(seqs: list[str]) -> list[str]:
    """Sequences of equal length with '-' for gaps: each is aligned with the first, and gaps once opened stay for all."""
    if not seqs:
        return []
    first, opened, placed = seqs[0], [0] * (len(seqs[0]) + 1), []
    for s in seqs:
        before, under = [""] * (len(first) + 1), ["-"] * len(first)
        at = 0
        for i, j in align_two(first, s) if s != first else [(n, n) for n in range(len(first))]:
            if i < 0:
                before[at] += s[j]
            else:
                under[i] = s[j] if j >= 0 else "-"
                at = i + 1
        opened = [max(n, len(x)) for n, x in zip(opened, before)]
        placed.append((before, under))
    return ["".join(x.ljust(n, "-") + c for x, n, c in zip(before, opened, [*under, ""])) for before, under in placed]


def aligned(paths: DataFrame, group: str, path_id: str = "path_id", seq: str = "seq") -> DataFrame:
    """(group, path_id, aln): the sequences of each group (a few, as path limits allow) laid side by side, in order of their ids."""
    fields = {f.name: f.dataType.simpleString() for f in paths.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(path_id)
        return pd.DataFrame({group: pdf[group], "path_id": pdf[path_id], "aln": align_all(pdf[seq].tolist())})

    return paths.select(group, path_id, seq).groupBy(group).applyInPandas(run, f"{group} {fields[group]}, path_id {fields[path_id]}, aln string")
