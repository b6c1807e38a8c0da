"""Word shingles of whole texts, hashed in Arrow batches."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs without ASCII white space (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct uint64 hashes of the ``width``-word shingles; fewer words make one shingle; none, none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    m = len(h) - k + 1
    out = h[:m].copy()
    for i in range(1, k):
        out *= MULTIPLIER
        out += h[i : i + m]
    out += np.uint64(k)
    out = _mixed(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]
