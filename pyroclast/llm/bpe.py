"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into words as byte-level tokenizers do (contractions, letters,
numbers, others, white space); the cuts are found by numpy over code points.
The distinct words of a batch go into a trie, walked depth first: sorted words
are visited in trie order, and a stack holds, for each prefix on the current
path, the *last token* of that prefix's encoding.  The encoding of a prefix is
its last token t after the encoding of what precedes t, so one state per node is
enough, and a prefix that many words share is encoded once.  t is the longest
token ending the prefix that may follow the state found at t's start; two
tokens may follow each other if undoing their merges, latest first, never shows
a pair across the border that would have merged earlier.

The work is one pass over the documents, without a shuffle; words seen before
in the same worker are looked up.  The vocabulary file is a parameter and is
read where the tasks run.

Edge cases: null text counts as empty and has no token; special tokens written
in a text become their ids, as the tokenizers library does by default; repeated
rows are encoded alike; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.arrays import flat, ragged, slices
from pyroclast.llm.wordcache import WordCache

#: The white space of the words' pattern, as code points.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each code point."""
    kind = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))[0]
        if category == "L":
            kind[c] = _LETTER
        elif category == "N":
            kind[c] = _NUMBER
    kind[WHITE] = _SPACE
    return kind


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is visible, else as the next unused code point from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary and its trie encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, alphabet = told["model"], _byte_alphabet()
        self.bytes = {i: bytes(alphabet[c] for c in token) for token, i in model["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        self.id = {b: i for i, b in self.bytes.items()}
        vocab = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[left + right]
            if made != 256 + i:
                raise ValueError("ids must follow the order of the merges")
            self.merged[vocab[left], vocab[right]] = made
            self.parts[made] = (vocab[left], vocab[right])
        self._automaton()
        table = [self.bytes.get(i, b"") for i in range(max([*self.bytes, *self.special.values()]) + 1)]
        for b, i in self.special.items():
            table[i] = b
        self.length = np.array([len(b) for b in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.all_bytes = np.frombuffer(b"".join(table), np.uint8)
        self._follows: dict[int, bool] = {}
        self.cache = WordCache(self.encode_words)

    def _automaton(self) -> None:
        """For the bytes read so far, the longest token that ends there (suffix links over a trie of the tokens).

        ``longest[state]`` is that token's id, ``shorter[id]`` the next token that
        ends with it; both are -1 where there is none.  ``step`` is filled as it is used.
        """
        trie: dict[int, int] = {}
        ends: dict[int, int] = {}
        depth_first, parent = [], [0]
        for token in sorted(self.id):
            state = 0
            for b in token:
                key = state << 8 | b
                below = trie.get(key)
                if below is None:
                    below = trie[key] = len(parent)
                    parent.append(state)
                    depth_first.append((below, key, b))
                state = below
            ends[state] = self.id[token]
        self.back, self.longest = [0] * len(parent), [-1] * len(parent)
        self.shorter = [-1] * (max(self.bytes) + 1)
        children: dict[int, list[tuple[int, int]]] = {}
        for below, key, b in depth_first:
            children.setdefault(key >> 8, []).append((below, b))
        level = [0]
        while level:
            coming = []
            for state in level:
                for below, b in children.get(state, ()):
                    back = self.back[state]
                    while back and back << 8 | b not in trie:
                        back = self.back[back]
                    self.back[below] = trie.get(back << 8 | b, 0) if state else 0
                    beyond = self.longest[self.back[below]]
                    self.longest[below] = ends.get(below, beyond)
                    if below in ends:
                        self.shorter[ends[below]] = beyond
                    coming.append(below)
            level = coming
        self.step = trie

    def _next(self, state: int, b: int) -> int:
        key, back = state << 8 | b, state
        while back and back << 8 | b not in self.step:
            back = self.back[back]
        self.step[key] = found = self.step.get(back << 8 | b, 0)
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE keeps this pair of tokens as it is."""
        if len(self._follows) > 2_000_000:
            self._follows.clear()
        known = self._follows[left << 20 | right] = self._undone(left, right)
        return known

    def _undone(self, left: int, right: int) -> bool:
        # Merges before `bound` are done when the border is (left, right); the later of the two is undone.
        bound = 1 << 62
        while True:
            made = self.merged.get((left, right))
            if made is not None and made < bound:
                return False
            # On equal ranks the leftmost occurrence merges first.
            if left > right:
                if left not in self.parts:
                    if right not in self.parts:
                        return True
                    bound, right = right + 1, self.parts[right][0]
                else:
                    bound, left = left, self.parts[left][1]
            elif right in self.parts:
                bound, right = right + 1, self.parts[right][0]
            elif left in self.parts:
                bound, left = left, self.parts[left][1]
            else:
                return True

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has."""
        order = sorted(range(len(words)), key=words.__getitem__)
        step, longest, shorter, memo = self.step, self.longest, self.shorter, self._follows
        size = self.length.tolist()
        path, states = [0], [0]  # of each prefix on the path: last token, and place in the tokens' trie
        found: list[list[int]] = [[]] * len(words)
        before = b""
        for i in order:
            word = words[i]
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            state, d = states[-1], shared
            for b in word[shared:]:
                d += 1
                below = step.get(state << 8 | b)
                state = self._next(state, b) if below is None else below
                token = longest[state]
                while (n := size[token]) < d:
                    left = path[d - n]
                    fits = memo.get(left << 20 | token)
                    if fits is None:
                        fits = self.follows(left, token)
                    if fits:
                        break
                    token = shorter[token]
                path.append(token)
                states.append(state)
            ids = []
            while d:
                token = path[d]
                ids.append(token)
                d -= size[token]
            found[i] = ids[::-1]
            before = word
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t for ids in found for t in ids), np.uint32, int(count.sum())), count

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts cut around special tokens, and the id of each piece that is one, else -1."""
        raw, cuts = data.tobytes(), {}
        for token, i in self.special.items():
            at = raw.find(token)
            while at >= 0:
                doc = np.searchsorted(offsets, at, "right")
                if at + len(token) <= offsets[doc]:
                    cuts[at] = (at + len(token), i)
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        edges = np.unique(np.concatenate([offsets, np.array([x for a, (b, _) in cuts.items() for x in (a, b)], np.int64)]))
        special = np.full(len(edges), -1, np.int64)
        for a, (_, i) in cuts.items():
            special[np.searchsorted(edges, a)] = i
        return edges, special

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        edges, special = self._segments(data, offsets)
        starts = word_starts(data, edges[:-1])
        ends = np.append(starts[1:], len(data))
        forced = special[np.minimum(np.searchsorted(edges, starts), len(edges) - 1)]
        forced = np.where(edges[np.minimum(np.searchsorted(edges, starts), len(edges) - 1)] == starts, forced, -1)
        # Inside a special piece there is one word only: its own.
        inside = special[np.searchsorted(edges, starts, "right") - 1] >= 0
        keep = ~inside | (forced >= 0)
        starts, ends, forced = starts[keep], ends[keep], forced[keep]
        ends = np.append(starts[1:], len(data))
        plain = forced < 0
        ids, some, _ = self.cache.tokens(data, starts[plain], ends[plain])
        count = np.ones(len(starts), np.int64)
        count[plain] = some
        out = np.empty(int(count.sum()), np.uint32)
        at = np.cumsum(count) - count
        out[at[~plain]] = forced[~plain]
        out[ragged(at[plain], some)] = ids
        doc = np.searchsorted(offsets, starts, "right") - 1
        return out, np.bincount(doc, count, len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of each text, end to end, and how many each text has; unknown ids have none."""
        known = (ids >= 0) & (ids < len(self.length))
        ids = np.where(known, ids, 0).astype(np.int64)
        size = np.where(known, self.length[ids], 0)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=edge[1:])
        last = np.cumsum(counts)
        return self.all_bytes[ragged(self.start[ids], size)], edge[last] - edge[last - counts]


def word_starts(data: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Byte offsets where words start; ``segments`` are the offsets of pieces that words don't cross."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        point = data
        first = segments
    else:
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.searchsorted(lead, segments)
    n = len(point)
    first = np.unique(first[first < n])
    kind = _kinds()[point]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    blank, space = kind == _SPACE, point == 0x20
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = np.zeros(n, bool)  # a space of the same piece comes just before
    after[1:] = space[:-1]
    after[first] = False
    start &= blank | ~after
    # The last white space before something else of the same piece: a word of its own, or the start of the next.
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~opens[1:n]
    last[n - 1] = False
    start |= last
    quote = np.flatnonzero(run & ~blank & ~after & (point == 0x27))
    room = np.searchsorted(np.append(first, n), quote, "right")
    end = np.append(first, n)[room]
    padded = np.concatenate([point, np.zeros(3, point.dtype)])
    a, b = padded[quote + 1], padded[quote + 2]
    one = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < end)
    two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quote + 2 < end)
    start[quote[one | two] + 1] = False
    follow = np.concatenate([quote[one] + 2, quote[two] + 3])
    start[follow[follow < n]] = True
    return lead[start] if len(lead) != len(data) else np.flatnonzero(start)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the whole text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, count = vocabulary(path).encode(*flat(batch.column("text")))
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))})

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text``: the ids' bytes, with U+FFFD for what isn't UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            count = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = _decoded(vocabulary(path), ids.flatten().to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def _decoded(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[str]:
    data, sizes = v.decode(ids, count)
    raw, end = data.tobytes(), np.cumsum(sizes).tolist()
    return [raw[b - n : b].decode("utf-8", "replace") for b, n in zip(end, sizes.tolist(), strict=True)]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, "text"):
            ids, count = v.encode(*flat(batch.column("text")))
            raw, end = ids.astype("<u4").tobytes(), np.cumsum(count)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": count,
                    "ids_sha256": [hashlib.sha256(raw[4 * (b - n) : 4 * b]).hexdigest() for b, n in zip(end.tolist(), count.tolist(), strict=True)],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(v, ids, count)],
                }
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
