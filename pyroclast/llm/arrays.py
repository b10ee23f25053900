"""Vectorised text primitives shared by the Arrow-based operators.

Everything here works on one Arrow batch inside a task: texts become one byte
array with document offsets, and words, hashes and windows are computed by
numpy over that array.  Batches are cut so that about ``CHUNK`` bytes of text
are in hand at a time; a single longer text is processed whole, so memory grows
with the longest document and not with the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: Words beyond this length are hashed and compared one by one.
_LONG = 1024
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

#: The white space of the contracts: bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches where the bytes of ``column`` would exceed ``limit``; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size.astype(np.int64)) // limit
        edges = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def to_binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of consecutive pieces of ``data``."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    kind, dtype = (pa.binary(), np.int32) if at[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(at.astype(dtype)), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the index ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each run of bytes that aren't white space."""
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, _U)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
        if n > 8 * CHUNK:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, that byte and the seven after it as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of each word.

    Words of up to seven bytes have different hashes; longer ones are mixed in
    block by block, which leaves no words known to collide, but equal hashes are
    no proof: what has to be exact compares (:func:`same`).
    """
    at_byte, size = eights(data), ends - starts
    h = mix((at_byte[starts] & _LOW[np.minimum(size, 7)]) | np.minimum(size, 8).astype(_U) << _U(56))
    long = np.flatnonzero(size > 7)
    at, left = starts[long], size[long]
    g = mix(left.astype(_U) + _U(0x9E3779B97F4A7C15))
    going = np.flatnonzero(left <= _LONG)
    while len(going):
        block = at_byte[at[going]] & _LOW[np.minimum(left[going], 8)]
        with np.errstate(over="ignore"):
            g[going] = mix((g[going] ^ block) * _U(0xD6E8FEB86659FD93) + _U(1))
        at[going] += 8
        left[going] -= 8
        going = going[left[going] > 0]
    for i in np.flatnonzero(size[long] > _LONG).tolist():
        whole = data[starts[long[i]] : ends[long[i]]].tobytes()
        g[i] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
    h[long] = g
    return h


def same(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes from each start are those from each of ``others`` in ``other``."""
    x, y = eights(data), eights(other)
    out = np.ones(len(starts), bool)
    a, b, left = starts.copy(), others.copy(), sizes.copy()
    going = np.flatnonzero((left > 0) & (left <= _LONG))
    while len(going):
        equal = ((x[a[going]] ^ y[b[going]]) & _LOW[np.minimum(left[going], 8)]) == 0
        out[going[~equal]] = False
        going = going[equal]
        a[going] += 8
        b[going] += 8
        left[going] -= 8
        going = going[left[going] > 0]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[others[i] : others[i] + sizes[i]])
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of value times power, from which any slice's hash follows.

    The values should be mixed 64-bit numbers that depend on their neighbours:
    for plain bytes there are long strings whose sums always agree.
    """
    power, _ = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    with np.errstate(over="ignore"):
        terms = values.astype(_U, copy=False) + _U(1)
        terms *= power[: len(values)]
        np.cumsum(terms, out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the slices [start, end); it depends on their content and length alone."""
    _, inverse = _power(len(sums))
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def slice_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """What :func:`slice_hash` gives for all slices of ``width`` values, in order."""
    _, inverse = _power(len(sums))
    many = max(0, len(sums) - width)
    with np.errstate(over="ignore"):
        h = sums[width:] - sums[:many]
        h *= inverse[:many]
        h += _U(width) * _U(0xD6E8FEB86659FD93)
    return mix(h)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of n consecutive 64-bit values."""
    if len(values) < n:
        return np.zeros(0, _U)
    m = len(values) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, _U)
        for i in range(n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + values[i : i + m])
    return h


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))
