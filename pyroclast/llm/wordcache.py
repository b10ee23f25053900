"""Encodings of distinct words, remembered by a worker between batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pyroclast.llm.arrays import ragged, same, word_hash

LIMIT = 1_500_000


class WordCache:
    """Token ids of distinct words, found by the words' hash and compared by their bytes; emptied when it would hold more than ``limit`` words.

    ``encode`` gets the distinct words that are new, and returns their ids end to
    end with the number of ids of each.  A word that shares its hash with
    another one in the cache is encoded by itself.  Words are only ever added at
    the end, and a table of slots, half full at most, leads from a hash to its word.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT, hashed: Callable = word_hash):
        self.encode, self.limit, self.hashed = encode, limit, hashed
        self._clear()

    def _clear(self) -> None:
        self.n, self.n_ids, self.n_text = 0, 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        # Of each word: hash, where its ids start and their number, where its bytes start and their number.
        self.words = np.zeros((1 << 15, 5), np.int64)
        self.ids, self.text = np.zeros(1 << 17, np.uint32), np.zeros(1 << 18, np.uint8)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's word, or -1."""
        slot, keys = self._slot(hashes), self.words[:, 0].view(np.uint64)
        word = self.slots[slot].astype(np.int64)
        others = np.flatnonzero((word >= 0) & (keys[word] != hashes))
        while len(others):
            slot[others] = slot[others] + 1 & len(self.slots) - 1
            word[others] = self.slots[slot[others]]
            others = others[(word[others] >= 0) & (keys[word[others]] != hashes[others])]
        return word

    def _link(self, hashes: np.ndarray, word: np.ndarray) -> None:
        """Give new hashes a slot: the first free one from their own on."""
        slot, left = self._slot(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = word[free]
            left = left[self.slots[slot[left]] != word[left]]
            slot[left] = slot[left] + 1 & len(self.slots) - 1

    def _add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        ids, count = self.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = ends - starts
        new = np.column_stack([hashes.view(np.int64), self.n_ids + np.cumsum(count) - count, count, self.n_text + np.cumsum(size) - size, size])
        self.words = _extended(self.words, self.n, new)
        self.ids = _extended(self.ids, self.n_ids, ids.astype(np.uint32))
        self.text = _extended(self.text, self.n_text, data[ragged(starts, size)])
        word = np.arange(self.n, self.n + len(new))
        self.n, self.n_ids, self.n_text = self.n + len(new), self.n_ids + len(ids), self.n_text + int(size.sum())
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length() - 1, -1, np.int32)
            hashes, word = self.words[: self.n, 0].copy().view(np.uint64), np.arange(self.n)
        self._link(hashes, word)

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words end to end, the number of ids of each word, and the words' hashes."""
        hashes = self.hashed(data, starts, ends)
        word = self._find(hashes)
        new = np.flatnonzero(word < 0)
        unique, first = np.unique(hashes[new], return_index=True)
        if self.n and self.n + len(unique) > self.limit:
            self._clear()
            new = np.arange(len(hashes))
            unique, first = np.unique(hashes, return_index=True)
        if len(new):
            first = new[first]
            self._add(unique, data, starts[first], ends[first])
            word[new] = self._find(hashes[new])
        _, start, count, place, length = self.words[word].T
        size = ends - starts
        equal = length == size
        # Our hash tells words of up to seven bytes apart.
        doubt = np.flatnonzero(equal & (size > 7) if self.hashed is word_hash else equal)
        equal[doubt] = same(data, starts[doubt], self.text[: self.n_text], place[doubt], size[doubt])
        ids, count = self.ids[ragged(start, count)], count.copy()
        if equal.all():
            return ids, count, hashes
        raw = data.tobytes()
        odd = np.flatnonzero(~equal)
        own, many = self.encode([raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        pieces = np.split(ids, np.cumsum(count)[:-1])
        for i, piece in zip(odd.tolist(), np.split(own, np.cumsum(many)[:-1]), strict=True):
            pieces[i] = piece.astype(np.uint32)
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64), hashes


def _extended(values: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``values`` with ``more`` after the first n, in place if there is room."""
    if n + len(more) > len(values):
        grown = np.zeros((max(2 * len(values), n + len(more)), *values.shape[1:]), values.dtype)
        grown[:n] = values[:n]
        values = grown
    values[n : n + len(more)] = more
    return values
