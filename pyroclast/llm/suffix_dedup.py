"""Suffix-array deduplication: removes every byte of a string that occurs more than once.

:mod:`~pyroclast.llm.repeats` narrows the corpus down to shards of contents that
may share a window.  In a shard the suffixes are sorted by bucket-pointer
refinement: initial buckets hold suffixes with the same q-gram (eight bytes);
each suffix points to its bucket; a bucket is refined by sorting its suffixes on
the pointers of the suffixes ``depth`` bytes later, and since these pointers are
themselves refined, the depth that a round settles doubles.  Suffixes alone in
their bucket drop out.  At the depth of a window, those in one bucket repeat.

Edge cases: null and empty texts, and texts shorter than the window, lose
nothing; all rows count as places, copies and repeated rows included (these lose
everything if they are long enough); matches never cross documents; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyroclast.llm.arrays import eights, flat, mix, ragged, slices
from pyroclast.llm.repeats import SHARD, Method, Shape, keyed, marks, repeated, with_repeats

WIDTH, GRAM, STEP, QGRAM = 200, 32, 43, 8


def values(count: int):
    """At each byte, a hash of ``count`` bytes (eight at most)."""

    def run(data: np.ndarray) -> np.ndarray:
        return mix(eights(data)[: len(data)] & np.uint64((1 << 8 * count) - 1))

    return run


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    """Dense numbers of the keys' values in their order; keys are below 2 to the power of ``bits``."""
    n = len(keys)
    shift = n.bit_length()
    if bits + shift < 64:  # keys and places sorted as one number
        both = np.sort(keys << np.int64(shift) | np.arange(n))
        order, keys = both & ((1 << shift) - 1), both >> np.int64(shift)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    number = np.zeros(n, np.int64)
    np.cumsum(keys[1:] != keys[:-1], out=number[1:])
    out = np.empty(n, np.int64)
    out[order] = number
    return out


def _split(bucket: np.ndarray, later: np.ndarray, count: int) -> np.ndarray:
    """Buckets refined by a second key, both below ``count`` (a shard's bytes, under 2^31); ids stay sorted and dense."""
    bits = count.bit_length()
    return _buckets(bucket << np.int64(bits) | later, 2 * bits)


def refine(data: np.ndarray, at: np.ndarray, shape: Shape, q: int = QGRAM) -> np.ndarray:
    """For each window of each content, whether its bucket at the depth of the window has company."""
    size = np.diff(at)
    windows = ragged(at[:-1], np.maximum(size - shape.width + 1, 0))
    # Suffixes that have q bytes left; what they hold is their first bucket.
    place = ragged(at[:-1], np.maximum(size - q + 1, 0))
    pointer = np.full(len(data) + 1, -1, np.int64)
    pointer[place] = _buckets((eights(data)[place] & np.uint64((1 << 8 * q) - 1)).view(np.int64), 64)
    left = np.repeat(at[1:], size) - np.arange(len(data))
    depth = q
    while depth < shape.width:
        step = min(depth, shape.width - depth)
        place = place[left[place] >= depth + step]
        own = pointer[place]
        company = np.bincount(own, minlength=1)[own] > 1
        if company.all():
            fine = _split(own, pointer[place + step], len(data))
        else:
            fine = np.empty(len(place), np.int64)
            fine[company] = _split(own[company], pointer[place[company] + step], len(data))
            fine[~company] = (fine[company].max(initial=-1) + 1) + np.arange(len(place) - int(company.sum()))
        # The windows' own starts are settled last; pointers of shorter suffixes are not used again.
        pointer[place] = fine
        depth += step
    own = pointer[windows]
    return np.bincount(own, minlength=1)[own] > 1


def _pieces(docs: DataFrame, width: int, shard: int, id_col: str, text_col: str) -> DataFrame:
    shape = Shape(width, min(GRAM, width // 4), max(1, (width - min(GRAM, width // 4) + 1) // 4 + 1))
    count = min(8, shape.gram)
    texts = keyed(docs, id_col, text_col)
    return with_repeats(texts, repeated(texts, Method(flat, values(count), count - 1, refine, np.dtype(np.uint8)), shape, shard))


def _kept(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat(batch.column("text"))
    gone = marks(batch, offsets)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[offsets[1:]] - before[offsets[:-1]]
    return data, offsets, gone, removed


def summary(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets, gone, removed = _kept(batch)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(first)])
            kept = data[~gone].tobytes()
            end = np.cumsum(np.diff(offsets) - removed)
            begin = np.concatenate([[0], end[:-1]])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": np.diff(offsets),
                    "n_removed": removed.astype(np.int64),
                    "n_spans": (spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64),
                    "kept_sha256": [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
                }
            )

    return _pieces(docs, width, shard, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id``, the ``text`` that is left (U+FFFD where a character was cut) and ``n_removed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets, gone, removed = _kept(batch)
            kept, end = data[~gone].tobytes(), np.cumsum(np.diff(offsets) - removed)
            begin = np.concatenate([[0], end[:-1]])
            texts = [kept[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_removed": removed.astype(np.int64)})

    return _pieces(docs, width, shard, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_removed long")
