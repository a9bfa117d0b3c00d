"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from .common import distinct

WIDTH = 5
_WEIGHTS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles.

    A-Z are lower-cased; words are runs without space and \\t\\n\\v\\f\\r. With
    fewer words, the whole sequence is one shingle; without words, or null, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out ^= hashes[k : n - width + 1 + k] * _WEIGHTS[k]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
    return distinct(out)
