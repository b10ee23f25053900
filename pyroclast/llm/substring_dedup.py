"""Substring deduplication: removes every word of a passage that occurs more than once.

:mod:`~pyroclast.llm.repeats` narrows the corpus down to shards of contents that
may share a window of words.  A shard is one compressed full-text index: the
Burrows-Wheeler transform of its contents, held in a wavelet tree (one packed bit
vector for each bit of a word's number, with a count at every 64th bit).  The contents are
then streamed against it by backward search: from each place where a window can
end, words are taken in leftwards while at least two places match.  The length
reached is that end's matching statistic (16 windows' length at most), and
statistics of the window's length or more give the passages that repeat.

Edge cases: null and empty texts, and texts with fewer words than a window, lose
nothing; all rows count as places, copies and repeated rows included; windows
never cross documents; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyroclast.llm.arrays import flat, grams, ragged, slices, word_hash, words
from pyroclast.llm.repeats import SHARD, Method, Shape, keyed, marks, repeated, with_repeats

WIDTH, GRAM = 35, 8


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(texts)
    starts, ends, doc = words(data, offsets)
    return word_hash(data, starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


def values(count: int):
    """At each word, a hash of ``count`` words; what goes beyond the last one stands for itself."""

    def run(hashes: np.ndarray) -> np.ndarray:
        return grams(np.concatenate([hashes, np.zeros(count - 1, np.uint64)]), count)

    return run


class Bits:
    """A bit vector in packed words, with the number of ones before each word."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(np.concatenate([ones, np.zeros(64 - len(ones) % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, upto: np.ndarray) -> np.ndarray:
        """How many ones there are before each place."""
        word = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Index:
    """Wavelet tree over the Burrows-Wheeler transform of ``symbols`` (0 ends a content)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = self._suffixes(symbols)
        transform = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.levels: list[tuple[int, Bits, int]] = []
        rest = transform
        for bit in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            ones = (rest >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), n - int(ones.sum())))
            rest = np.concatenate([rest[~ones], rest[ones]])
        # Where each symbol's run begins on the last level.
        self.base = np.zeros(int(symbols.max()) + 2, np.int64)
        found, first = np.unique(rest, return_index=True)
        self.base[found] = first

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; suffixes of cyclic shifts, told apart by place where all symbols agree."""
        n = len(symbols)
        rank, depth = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while depth < n:
            later = rank[(np.arange(n) + depth) % n]
            order = np.lexsort((later, rank))
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])
            ranks = np.cumsum(new)
            rank = np.empty(n, np.int64)
            rank[order] = ranks
            if ranks[-1] == n - 1:
                break
            depth *= 2
        return order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before ``upto``."""
        at = upto
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at - self.base[symbol]

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """For each end, how many symbols leftwards (``longest`` at most) occur in at least two places."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(symbols), np.int64)
        going = np.flatnonzero(longest > 0)
        while len(going):
            c = symbols[ends[going] - 1 - length[going]]
            a = self.before[c] + self.rank(c, lo[going])
            b = self.before[c] + self.rank(c, hi[going])
            more = b - a >= 2
            going, a, b = going[more], a[more], b[more]
            lo[going], hi[going] = a, b
            length[going] += 1
            going = going[length[going] < longest[going]]
        return length


def match(data: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """For each window of each content, whether it occurs in two places of the shard."""
    size = np.diff(at)
    number = np.unique(data, return_inverse=True)[1].astype(np.int64) + 1
    # Contents follow each other with symbol 0 between them.
    start = at[:-1] + np.arange(len(size))
    symbols = np.zeros(len(data) + len(size), np.int64)
    symbols[ragged(start, size)] = number
    windows = np.maximum(size - shape.width + 1, 0)
    row = np.repeat(np.arange(len(size)), windows)
    ends = ragged(start + shape.width, windows)
    index, yes = Index(symbols), np.zeros(len(row), bool)
    # A statistic above the threshold tells of all windows inside its stretch, so ends far apart are asked first,
    # with statistics up to ``most``; what they leave open is asked at closer ends, at last at each.
    waiting = np.arange(len(row))
    for times in (16, 8, 4, 2, 1):
        if not len(waiting):
            break
        most = times * shape.width
        new = np.ones(len(waiting), bool)
        new[1:] = (np.diff(waiting) > 1) | (row[waiting[1:]] != row[waiting[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(waiting)) - 1
        from_end = last[np.cumsum(new) - 1] - np.arange(len(waiting))
        asked = waiting[from_end % (most - shape.width + 1) == 0]
        reach = index.statistics(symbols, ends[asked], np.minimum(ends[asked] - start[row[asked]], most))
        good = reach >= shape.width
        depth = np.zeros(len(row) + 1, np.int64)
        np.add.at(depth, asked[good] - (reach[good] - shape.width), 1)
        np.add.at(depth, asked[good] + 1, -1)
        yes |= np.cumsum(depth[:-1]) > 0
        decided = yes.copy()
        decided[asked] = True
        waiting = waiting[~decided[waiting]]
    return yes


def _pieces(docs: DataFrame, width: int, shard: int, id_col: str, text_col: str) -> DataFrame:
    gram = min(GRAM, max(1, width // 4))
    shape = Shape(width, gram, max(1, (width - gram + 1) // 4))
    count = min(2, gram)
    texts = keyed(docs, id_col, text_col)
    return with_repeats(texts, repeated(texts, Method(read, values(count), count - 1, match, np.dtype(np.uint64)), shape, shard))


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Number of words, of removed words, and the kept ones joined by a space, for each document."""
    data, offsets = flat(batch.column("text"))
    starts, ends, doc = words(data, offsets)
    at = np.searchsorted(doc, np.arange(len(offsets)))
    gone = marks(batch, at)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[at[1:]] - before[at[:-1]]
    stay = ~gone
    length = (ends - starts)[stay] + 1
    joined = np.full(int(length.sum()), 0x20, np.uint8)
    to = np.cumsum(length) - length
    joined[ragged(to, length - 1)] = data[ragged(starts[stay], length - 1)]
    raw = joined.tobytes()
    size = np.bincount(doc[stay], length, len(offsets) - 1).astype(np.int64)
    end = np.cumsum(size)
    for n, r, a, b in zip(np.diff(at).tolist(), removed.tolist(), (end - size).tolist(), end.tolist(), strict=True):
        yield n, r, raw[a : max(a, b - 1)]


def summary(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_kept(batch))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array([x[0] for x in found], pa.int64()),
                    "n_removed": pa.array([x[1] for x in found], pa.int64()),
                    "kept_sha256": [hashlib.sha256(x[2]).hexdigest() for x in found],
                }
            )

    return _pieces(docs, width, shard, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id``, the ``text`` that is left (words joined by a space) and ``n_removed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(_kept(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([x[2].decode() for x in found], pa.string()), "n_removed": pa.array([x[1] for x in found], pa.int64())})

    return _pieces(docs, width, shard, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_removed long")
