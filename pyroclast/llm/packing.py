"""Packing documents into training sequences along a space-filling curve.

A document's words are hashed into a vector, which a fixed random projection
maps to four dimensions; the cell it falls in has a place on a Hilbert curve, so
documents with similar words are close on the curve.  Documents are range-sorted
by that key and laid end to end in this order; every ``capacity`` tokens a
sequence is full, and a document that doesn't fit goes on in the next one.  Only
the end of the whole stream is left over: it is cut into lengths that are powers
of two, which need no padding, so no token of padding is ever needed.

Steps: (1) one pass tokenises, and writes ids, key and number of tokens;
(2) key, row and number alone are range-sorted, and running sums within the
ranges and over the ranges' totals give each document's place in the stream;
(3) the place is joined back by row, and each task cuts its own documents.
Equal keys, as of copies, are parted by the id, so no range can grow hot.

Edge cases: a null or empty text is the end token alone; null ids sort first;
repeated rows are packed once each; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.arrays import flat, ragged, slices, to_binary, words
from pyroclast.llm.storage import stored
from pyroclast.llm.wordcache import WordCache

CAPACITY = 2048
END = 1
DIMENSIONS, BITS = 4, 15

#: Neighbouring words that a tokenizer may treat differently beside white space.
PROBES = [("a", "b"), ("The", "end."), ("don't", "'s"), ("12", "3rd"), ("!?", "..."), ("été", "日本"), ("e", "\u0301x")]

#: Letters (all of two bytes have 0xC3 first) and marks; words of letters, then marks, are what texts are mostly made of.
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
MARKS = [c for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]

_KINDS, _SECOND = np.zeros(256, np.uint8), np.zeros(256, bool)
_KINDS[[ord(c) for c in LETTERS if c < "\x80"]], _KINDS[[ord(c) for c in MARKS]] = 1, 2
_SECOND[[c.encode()[1] for c in LETTERS if c > "\x80"]] = True

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20_240_229).normal(size=(4096, DIMENSIONS))


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``axes``), each coordinate of ``bits`` bits."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[i] >> b & 1
    return place


def curve_keys(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hilbert keys of n documents from the hashes of their words (grouped by document)."""
    place = (hashes >> np.uint64(52)).astype(np.int64)
    count = np.bincount(doc, minlength=n)
    table = _projection()
    sums = np.column_stack([np.bincount(doc, table[place, j], n) for j in range(DIMENSIONS)])
    z = sums / np.sqrt(np.maximum(count, 1))[:, None]
    cell = (1 / (1 + np.exp(-np.clip(z, -30, 30))) * ((1 << BITS) - 1)).astype(np.int64)
    return hilbert(cell)


def pieces_of(raw: list[bytes]) -> np.ndarray:
    """1 for words of ``LETTERS`` or of ``MARKS``, 2 for words of letters and then marks, 0 for others."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size)
    first = np.zeros(len(data) + 1, bool)
    first[ends - size] = True
    lead = np.append(False, data == 0xC3) & ~first  # by the byte after it
    letter, mark = _KINDS[data] == 1, _KINDS[data] == 2
    second = lead[:-1] & _SECOND[data]
    letter |= second | np.append(second[1:], False)
    bad = ~(letter | mark)
    bad[1:] |= letter[1:] & mark[:-1] & ~first[1:-1]
    sums = [np.append(0, np.cumsum(x)) for x in (letter, mark, bad)]
    letters, marks, bads = (x[ends] - x[ends - size] for x in sums)
    return np.where(bads > 0, 0, (letters > 0).astype(np.int64) + (marks > 0))


class Tokens:
    """Token ids of texts through the tokenizers library, each distinct word of white-space-cut text once.

    This asks of the tokenizer that white space separates words and is dropped, which is
    tried when it is loaded (ValueError if it isn't so).
    The words go in as one string with a special token between them.  Where
    the tokenizer's model ends each piece of a word with a suffix, words of letters and
    words of letters and then marks, one piece and two, go in with blanks between them, which
    costs it half as much, and the suffixes tell them apart.  Unless there are
    as many as these words have pieces, they go in with the special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        if not special or any(not s or any(c.isspace() for c in s) for s in self.special):
            raise ValueError(f"{path}: words need a special token between them, and none may hold white space")
        self.mark_id, self.mark = max((i, t.content) for i, t in special.items())
        self.lead = os.path.commonprefix(self.special)  # spares most words a search for each special token
        self._try(path)
        self.closing = self._closing()
        self.cache = WordCache(self._encode)

    def _try(self, path: str) -> None:
        """Raise ValueError unless words have the same ids alone, between white space, and between special tokens."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for one, two in PROBES:
            apart = [ids(one), ids(two)]
            for space in " \t\n\v\f\r":
                if ids(f"{space}{one}{space}{space}{two}{space}") != apart[0] + apart[1]:
                    raise ValueError(f"{path}: white space doesn't only separate words")
            if ids(one + self.mark + two) != [*apart[0], self.mark_id, *apart[1]]:
                raise ValueError(f"{path}: {self.mark} doesn't only separate words")

    def _closing(self) -> np.ndarray | None:
        """For each id, whether it ends a piece of a word; None unless letters and marks are tried to be such pieces."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        closing = np.zeros(max(vocabulary.values(), default=0) + 1 + self.mark_id, bool)
        closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        for probes, pieces in ((LETTERS, 1), (MARKS, 1), ([f"e{m}" for m in MARKS], 2), ([f"{c}." for c in LETTERS], 2)):
            for probe in probes:
                if any(s in probe for s in self.special):
                    return None
                ids = self.tokenizer.encode(probe, add_special_tokens=False).ids
                if not ids or closing[ids].sum() != pieces or not closing[ids[-1]]:
                    return None
        return closing

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = pieces_of(raw)
        ids, count = [], np.zeros(len(raw), np.int64)
        for pieces in (1, 2, 0):
            at = np.flatnonzero(parts == pieces)
            for a in range(0, len(at), 4096):
                some = at[a : a + 4096]
                words_ = [raw[i] for i in some.tolist()]
                found = self._spaced(words_, pieces) if pieces and self.closing is not None else None
                own, count[some] = found or self._marked(words_)
                ids.append(own)
        # From the order of the kinds back to that of the words.
        order = np.concatenate([np.flatnonzero(parts == pieces) for pieces in (1, 2, 0)])
        start = np.empty(len(raw), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate([np.zeros(0, np.uint32), *ids])[ragged(start, count)], count

    def _spaced(self, raw: list[bytes], pieces: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Words of so many pieces each with blanks between them; None if the ids don't show as many."""
        text = b" ".join(raw).decode()
        if any(s in text for s in self.special):
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != pieces * len(raw) or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends[pieces - 1 :: pieces], prepend=0)

    def _marked(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in raw]
        odd = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if self.lead in t and any(s in t for s in self.special)}
        for i in odd:
            texts[i] = ""
        parts, counts = [], []
        for a in range(0, len(texts), 4096):
            some = texts[a : a + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.concatenate([[-1], np.flatnonzero(ids == self.mark_id), [len(ids)]])
            counts.append(np.diff(at) - 1)
            parts.append(ids[ids != self.mark_id])
        ids, count = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        if odd:
            start = np.cumsum(count) - count
            pieces = [odd[i] if i in odd else ids[start[i] : start[i] + count[i]] for i in range(len(texts))]
            ids, count = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, count

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end with ``end`` after each text, their number in each text, and the texts' Hilbert keys."""
        n = len(offsets) - 1
        starts, ends, doc = words(data, offsets)
        ids, count, hashes = self.cache.tokens(data, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        total = np.bincount(doc, count, n).astype(np.int64)
        out = np.full(len(ids) + n, end, np.uint32)
        at = np.cumsum(total + 1) - (total + 1)
        out[ragged(at, total)] = ids
        return out, total + 1, curve_keys(hashes, doc, n)


@lru_cache(2)
def tokens_of(path: str) -> Tokens:
    """One per worker and file."""
    return Tokens(path)


def tokenise(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, curve ``key``, number ``n`` of tokens, and ``ids`` in two bytes each, or four where an id needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, count, key = tokens_of(path).encode(*flat(batch.column("text")), end)
            width = np.dtype("<u2") if not len(ids) or ids.max() < 1 << 16 else np.dtype("<u4")
            data = ids.astype(width).view(np.uint8)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": key, "n": count, "ids": to_binary(data, count * width.itemsize)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, ids binary")


def stream_places(sizes: DataFrame) -> DataFrame:
    """``row`` and ``place``, the tokens of all documents before it in the order (key, doc_id, row)."""
    ranges = sizes.repartitionByRange("key", "doc_id", "row").select("*", F.spark_partition_id().alias("part"))
    ranges = stored(ranges, "packing-ranges")  # its cuts are drawn from a sample, so they are settled once
    totals = ranges.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))  # one row a range
    inside = Window.partitionBy("part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, "part").select("row", (F.col("base") + F.col("inside")).alias("place"))


def edges(total: int, capacity: int) -> tuple[int, list[int]]:
    """Number of full sequences, and where the rest is cut: into powers of two, the largest first."""
    full, rest = divmod(total, capacity)
    cuts, at = [full * capacity], full * capacity
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return full, cuts


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence."""
    tokens = stored(tokenise(docs, path, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    sizes = tokens.select("doc_id", "key", "n", "row")
    full, cuts = edges(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], capacity)
    tail = np.array(cuts, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            place = batch.column("place").to_numpy()
            data, at = flat(batch.column("ids"))
            last = place + n
            # A document is in the sequences from that of its first token to that of its last.
            first_seq = np.where(place < tail[0], place // capacity, full + np.searchsorted(tail, place, "right") - 1)
            last_seq = np.where(last - 1 < tail[0], (last - 1) // capacity, full + np.searchsorted(tail, last - 1, "right") - 1)
            many = last_seq - first_seq + 1
            doc = np.repeat(np.arange(len(n)), many)
            seq = ragged(first_seq, many)
            opens = np.where(seq < full, seq * capacity, tail[np.clip(seq - full, 0, len(tail) - 1)])
            shuts = np.where(seq < full, (seq + 1) * capacity, tail[np.clip(seq - full + 1, 0, len(tail) - 1)])
            a, b = np.maximum(place[doc], opens), np.minimum(last[doc], shuts)
            width = np.where(np.diff(at) == 2 * n, 2, 4)
            raw = data.tobytes()
            crcs = []
            for i, x, y in zip(doc.tolist(), (a - place[doc]).tolist(), (b - place[doc]).tolist(), strict=True):
                w = int(width[i])
                piece = raw[at[i] + w * x : at[i] + w * y]
                crcs.append(zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes() if w == 2 else piece))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "start": a - place[doc],
                    "length": b - a,
                    "ids_crc32": np.array(crcs, np.int64),
                    "doc_tokens": n[doc],
                    "sequence_id": seq,
                    "offset": a - opens,
                }
            )

    return tokens.select("doc_id", "n", "ids", "row").join(stream_places(sizes), "row").mapInArrow(cut, _PIECES)
