"""Distinct word shingles of each document, as sorted 64-bit hashes.

Letters A to Z are lower-cased and words are runs of ``[^\\x20\\x09-\\x0D]``.
A document with fewer words than a shingle is one shingle, its whole word
sequence; one without words has none.
"""

from __future__ import annotations

import numpy as np

from pyroclast.llm.arrays import grams, word_hash, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SHORT = 0x5851F42D4C957F2D


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents, end to end, and where each document's begin (one more at the end)."""
    n = len(offsets) - 1
    low = _LOWER[data]
    starts, ends, doc = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = word_hash(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    own = grams(h, width)
    of = doc[: len(own)]
    whole = of == doc[width - 1 :] if len(own) else np.zeros(0, bool)
    own, of = own[whole], of[whole]
    first = np.cumsum(count) - count
    for k in range(1, width):
        few = np.flatnonzero(count == k)
        if len(few):
            g = np.full(len(few), _SHORT * k % 2**64, np.uint64)
            for i in range(k):
                g = grams(np.column_stack([g, h[first[few] + i]]).ravel(), 2)[::2]
            own, of = np.concatenate([own, g]), np.concatenate([of, few])
    order = np.lexsort((own, of))
    own, of = own[order], of[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    own, of = own[new], of[new]
    return own, np.searchsorted(of, np.arange(n + 1))
