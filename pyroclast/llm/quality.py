"""Quality classifier: a factorisation machine over hashed words and structure.

A text becomes a sparse vector: its words hashed into ``2**HASH_BITS`` places
(log counts, scaled to length one), and its structure statistics with the
text's length, each both standardised and cut into bins.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

whose right-hand sum is every pairwise interaction <v_i, v_j> x_i x_j in time
linear in the number of words.

Metadata are numeric columns named by the caller (``metadata``): each adds its
signed logarithm and whether it is missing (null or not finite) to the statistics.

The model is fitted on a bounded sample: ``sample_rows`` labelled rows with the
least ``xxhash64(id)``, the same ones on every run.  Only their vectors reach
the driver, one for each id and label and never more than ``2**HASH_BITS`` places each.  Everything is scored, in one pass without a shuffle; the broadcast
model has a fixed size of ``(2**HASH_BITS + bins) x (RANK + 1)`` floats.

Edge cases: a null text counts as empty and is scored from its structure alone;
null labels are not learned from; with no labelled row every score is the prior
0.5; labels repeated for one id count once each way they are given; of rows that
repeat an id with different texts one is learned from, chosen by a hash; repeated
rows are scored alike; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.arrays import SPACE, flat, slices, word_hash, words

HASH_BITS = 15
RANK = 6
SAMPLE_ROWS = 12_000
BINS = 12
STATS = 16

_PLACES = 1 << HASH_BITS


@dataclass
class Model:
    """Weights, factors, and how the statistics are standardised and cut."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray
    metadata: tuple[str, ...] = ()


def size_of(stats: int) -> int:
    """Places of words, of ``stats`` statistics and of their bins."""
    return _PLACES + stats * (BINS + 1)


def _class(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)])


_KINDS = np.stack([_class(str.isalpha), _class(str.isdigit), _class(str.isupper), _class(lambda c: c in ".,;:!?"), _class(lambda c: not (c.isalnum() or c.isspace() or c in ".,;:!?'-")), np.arange(256) >= 128, SPACE, np.arange(256) == 0x0A])


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, place and value of the hashed words, and the statistics of each document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, doc = words(data, offsets)
    h = word_hash(data, starts, ends)
    count = np.bincount(doc, minlength=n).astype(float)
    key, times = np.unique(doc.astype(np.uint64) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS), return_counts=True)
    row = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value /= np.maximum(norm[row], 1e-9)

    some = np.flatnonzero(size)
    share = np.zeros((n, len(_KINDS)))
    for j, kind in enumerate(_KINDS):
        share[some, j] = np.add.reduceat(kind[data], offsets[:-1][some], dtype=np.int64) if len(some) else 0
    lines = share[:, -1] + 1
    kinds = np.bincount(row, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    squares = np.bincount(row, times.astype(float) ** 2, n)
    length = ends - starts
    mean_length = np.bincount(doc, length, n) / np.maximum(count, 1)
    long_words = np.bincount(doc, length > 14, n) / np.maximum(count, 1)
    stats = np.column_stack(
        [np.log1p(size), np.log1p(count), mean_length, share[:, :-1] / np.maximum(size, 1)[:, None], kinds / np.maximum(count, 1), most / np.maximum(count, 1), squares / np.maximum(count, 1) ** 2, np.log1p(lines), count / lines, long_words]
    )
    return row, (key & np.uint64(_PLACES - 1)).astype(np.int32), value.astype(np.float32), stats


def _with_metadata(stats: np.ndarray, batch: pa.RecordBatch, metadata: tuple[str, ...]) -> np.ndarray:
    """The statistics with two columns for each of metadata: signed logarithm (0 where missing), and whether it is missing."""
    more = []
    for i in range(len(metadata)):
        x = batch.column(f"m{i}").to_numpy(zero_copy_only=False).astype(float)
        gone = ~np.isfinite(x)
        x = np.where(gone, 0, x)
        more += [np.sign(x) * np.log1p(np.abs(x)), gone.astype(float)]
    return np.column_stack([stats, *more])


def _with_stats(m: Model, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse rows, ordered by document, with standardised and cut statistics added."""
    many = stats.shape[1]
    z = np.clip((stats - m.mean) / m.spread, -4, 4) * 0.25
    cut = (stats[:, :, None] > m.cuts[None]).sum(2)
    j = np.arange(many)
    rows = np.repeat(np.arange(n), 2 * many)
    places = np.concatenate([np.broadcast_to(_PLACES + j, (n, many)), _PLACES + many + j * BINS + cut], axis=1).ravel()
    values = np.concatenate([z, np.full((n, many), 0.35)], axis=1).ravel()
    rows, places, values = np.concatenate([row, rows]), np.concatenate([place, places]), np.concatenate([value, values])
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order], values[order].astype(np.float32)


def _scores(m: Model, n: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    first = np.searchsorted(row, np.arange(n))
    vx = m.factor[place] * value[:, None]
    s = np.add.reduceat(vx, first, axis=0)
    q = np.add.reduceat(vx * vx, first, axis=0)
    linear = np.add.reduceat(m.weight[place] * value, first)
    return 1 / (1 + np.exp(-np.clip(m.bias + linear + 0.5 * (s * s - q).sum(1), -30, 30)))


def _features(metadata: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, place, value, stats = vectors(*flat(batch.column("text")))
            stats = _with_metadata(stats, batch, metadata)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "label": batch.column("label"),
                    "place": pa.ListArray.from_arrays(pa.array(at), pa.array(place)),
                    "value": pa.ListArray.from_arrays(pa.array(at), pa.array(value)),
                    "stats": pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * stats.shape[1]), pa.array(stats.ravel())),
                }
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, epochs: int = 6, seed: int = 7) -> Model | None:
    """Fit on at most ``sample_rows`` rows of ``labels`` whose label is 0 or 1; None if there is none."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)  # at most sample_rows pairs of numbers
    told = F.struct(F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    found = docs.select(F.col(id_col).cast("long").alias("id"), told.alias("told")).join(F.broadcast(chosen), "id")
    one = found.groupBy("id", "label").agg(F.min_by("told", F.xxhash64("told")).alias("told")).select("id", "label", "told.*")
    table = one.mapInArrow(_features(metadata), "id long, label int, place array<int>, value array<float>, stats array<double>").toArrow()
    if not table.num_rows:
        return None
    table = table.combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks()
    place, value = (table.column(c).combine_chunks() for c in ("place", "value"))
    n = table.num_rows
    stats = table.column("stats").combine_chunks().flatten().to_numpy().reshape(n, -1)
    row = np.repeat(np.arange(n), place.value_lengths().to_numpy())
    y = table.column("label").to_numpy().astype(np.float32)
    rng = np.random.default_rng(seed)
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    size = size_of(stats.shape[1])
    m = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), stats.mean(0), stats.std(0) + 1e-6, cuts, tuple(metadata))
    rate = min(max(float(y.mean()), 0.01), 0.99)
    m.bias = float(np.log(rate / (1 - rate)))
    row, place, value = _with_stats(m, n, row, place.flatten().to_numpy(), value.flatten().to_numpy(), stats)
    _train(m, row, place, value, y, epochs, rng)
    return m


def _train(m: Model, row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator, batch: int = 64, rate: float = 0.08, decay: float = 2e-5) -> None:
    """Adagrad on the logistic loss, in mini-batches of whole documents."""
    n = len(y)
    first = np.searchsorted(row, np.arange(n + 1))
    gw, gv, gb = np.full(m.weight.shape, 1e-4, np.float32), np.full(m.factor.shape, 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            docs = order[a : a + batch]
            size = first[docs + 1] - first[docs]
            at = np.arange(size.sum()) + np.repeat(first[docs] - (np.cumsum(size) - size), size)
            p, x = place[at], value[at]
            start = np.cumsum(size) - size
            vx = m.factor[p] * x[:, None]
            s = np.add.reduceat(vx, start, axis=0)
            q = np.add.reduceat(vx * vx, start, axis=0)
            z = m.bias + np.add.reduceat(m.weight[p] * x, start) + 0.5 * (s * s - q).sum(1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]
            gx = np.repeat(g, size) * x
            dv = gx[:, None] * (np.repeat(s, size, axis=0) - vx)
            sort = np.argsort(p, kind="stable")
            u, begin = np.unique(p[sort], return_index=True)
            dw = np.add.reduceat(gx[sort], begin) / len(docs) + decay * m.weight[u]
            dv = np.add.reduceat(dv[sort], begin, axis=0) / len(docs) + decay * m.factor[u]
            gw[u] += dw**2
            gv[u] += dv**2
            m.weight[u] -= rate * dw / np.sqrt(gw[u])
            m.factor[u] -= rate * 0.5 * dv / np.sqrt(gv[u])
            gb += float(g.mean()) ** 2
            m.bias -= rate * float(g.mean()) / gb**0.5


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (1 if the score reaches ``threshold``)."""
    metadata = [] if model is None else model.metadata
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            row, place, value, stats = vectors(*flat(batch.column("text")))
            stats = _with_metadata(stats, batch, m.metadata)
            p = _scores(m, batch.num_rows, *_with_stats(m, batch.num_rows, row, place, value, stats)).astype(float)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
