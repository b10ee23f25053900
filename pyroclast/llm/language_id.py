"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to 3).  A byte
costs -log2 of its probability after the longest context the tree holds; a byte
not seen there escapes to the next shorter one.  Escapes follow method C with
exclusion: a context of n bytes and d different ones gives c / (n + d) to a
byte seen c times, and d / (n + d) to all others in proportion to what the
shorter context gives them, so that the 256 probabilities of each context sum
to one and the code length of a text is exact.  Order -1 is uniform.

Counting is one distributed pass over every training text; the statistics are
frozen before scoring.  Every counted context is kept, for each language by
itself, so the model grows with the training text; it is a written table with a
row per byte seen after a context and per escape.  Scoring cuts it by the two
bytes before the coded one into shards of about ``SHARD`` rows, which hold all
orders of their contexts (orders 0 and 1 are in each shard).  A model of one
shard is broadcast and scoring is one pass without a shuffle; with more shards,
each is broadcast by itself for a pass over the texts that codes the bytes that
belong to it, and the bits of a text are added up by the digest of the text.

Edge cases: a null or empty text, or one without a letter, is ``und`` with
score 0; so is everything if no training row has a language; rows with null
text or language aren't learned from; equal code lengths go to the language
whose name sorts first; repeated rows are scored alike; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.arrays import flat, ragged, slices
from pyroclast.llm.storage import stored

ORDER = 3
#: Rows of the model that are sent to a task at once (12 bytes each).
SHARD = 2_000_000
UNDETERMINED = "und"
_PAD = 0x0A
_U = np.uint64
_SCORED = "doc_id long, lang_pred string, score double, bits_per_byte double, n_bytes long"


@dataclass
class Shard:
    """Part of a model: for contexts whose last two bytes are from ``first`` to ``last``, sorted keys and bits.

    ``seen[k]`` has the bytes seen after contexts of k bytes (key: language, context, byte), ``escape[k]``
    what it costs to leave such a context (key: language, context).
    """

    first: int
    last: int
    seen: list[tuple[np.ndarray, np.ndarray]]
    escape: list[tuple[np.ndarray, np.ndarray]]

    def bits(self, grams: np.ndarray, language: int) -> np.ndarray:
        """What the last byte of each gram (three bytes of context and the byte) costs."""
        out = np.zeros(len(grams))
        rest = np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            mine = grams[rest] & _U(256 ** (k + 1) - 1)
            cost, found = _look_up(self.seen[k], _U(language << 32) | mine)
            out[rest] += cost
            rest, mine = rest[~found], mine[~found]
            out[rest] += _look_up(self.escape[k], _U(language << 32) | mine >> _U(8))[0]
        out[rest] += 8
        return out


@dataclass
class Model:
    """Frozen statistics: languages, the table of bits (lang, k, escape, key, bits) and the ranges of its shards."""

    languages: list[str]
    table: DataFrame
    ranges: list[tuple[int, int]]
    _whole: Shard | None = field(default=None, repr=False)

    def shard(self, i: int) -> Shard:
        if len(self.ranges) == 1 and self._whole is not None:
            return self._whole
        first, last = self.ranges[i]
        found = _shard(self.table.where(f"place IS NULL OR place BETWEEN {first} AND {last}").select("lang", "k", "escape", "key", "bits").toArrow(), first, last, self.languages)
        if len(self.ranges) == 1:
            self._whole = found
        return found

    @property
    def _bytes(self) -> np.ndarray:
        """Every byte seen, and one that stands for all others."""
        seen = np.unique(self.shard(0).seen[0][0] & _U(255))
        return np.append(seen, np.setdiff1d(np.arange(256, dtype=_U), seen)[:1] if len(seen) < 256 else _U(0))

    @property
    def symbols(self) -> int:
        return len(self._bytes)

    @property
    def bits(self) -> np.ndarray:
        """All distributions of a small model in full: ``bits[context * symbols + symbol, language]``, the last symbol for any byte never seen."""
        shard = self.shard(0)
        contexts = np.unique(np.concatenate([keys & _U(0xFFFFFFFF) for keys, _ in shard.escape]))
        grams = (contexts[:, None] << _U(8) | self._bytes).ravel()
        return np.column_stack([shard.bits(grams, i) for i in range(len(self.languages))])


def _look_up(entries: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each key, 0 where there is no entry, and where there is one."""
    own, bits = entries
    if not len(own):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    found = own[at] == keys
    return np.where(found, bits[at], 0), found


def _shard(table: pa.Table, first: int, last: int, languages: list[str]) -> Shard:
    k, escape, key, bits = (table.column(c).to_numpy() for c in ("k", "escape", "key", "bits"))
    names = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    which = np.array([languages.index(x) for x in names.dictionary.to_pylist()], _U)
    key = which[names.indices.to_numpy()] << _U(32) | key.astype(_U)
    parts: dict[bool, list] = {False: [], True: []}
    for kind, out in parts.items():
        for order in range(ORDER + 1):
            mine = np.flatnonzero((k == order) & (escape == kind))
            mine = mine[np.argsort(key[mine])]
            out.append((key[mine], bits[mine].astype(np.float32)))
    return Shard(first, last, parts[False], parts[True])


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``ORDER`` line feeds before each, and where their own bytes are."""
    lengths = np.diff(offsets)
    at = ragged(offsets[:-1] + ORDER * np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(data) + ORDER * len(lengths), _PAD, np.uint8)
    out[at] = data
    return out, at


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}
    for batch in slices(batches, "text"):
        names = batch.column("lang").to_pylist()
        data, offsets = flat(batch.column("text"))
        text, at = _padded(data, offsets)
        wide = text.astype(np.uint32)
        keys = wide[at - 3] << 24 | wide[at - 2] << 16 | wide[at - 1] << 8 | wide[at]
        lengths = np.diff(offsets)
        for name in dict.fromkeys(names):
            mine = keys[np.repeat([x == name for x in names], lengths)]
            parts = found.setdefault(name, [])
            parts.append(np.unique(mine, return_counts=True))
            if len(parts) > 16:
                parts[:] = [_merged(parts)]
    for name, parts in found.items():
        keys, n = _merged(parts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys)), "gram": keys.astype(np.int64), "n": n})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 1) -> Model | None:
    """Learn from every row of ``docs`` whose text and language aren't null; None if there is none.

    Contexts of two and three bytes that all languages together have seen fewer
    than ``least`` times are left out.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    grams = stored(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm-grams")
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not languages:
        return None
    orders = F.explode(F.array(*[F.lit(k) for k in range(ORDER + 1)])).alias("k")
    by_order = grams.select("lang", "gram", "n", orders).select("lang", "k", F.expr("gram & (CAST(power(256, k + 1) AS LONG) - 1)").alias("gram"), "n")
    by_order = by_order.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).withColumn("context", F.expr("gram >> 8"))
    if least > 1:  # a shorter context is at least as frequent, so all suffixes of a context stay
        by_order = by_order.withColumn("all", F.sum("n").over(Window.partitionBy("k", "context"))).where((F.col("k") < 2) | (F.col("all") >= least)).drop("all")
    own = Window.partitionBy("lang", "k", "context")  # at most 256 rows
    by_order = by_order.withColumn("total", F.sum("n").over(own)).withColumn("kinds", F.count("*").over(own))
    chances = stored(by_order.select("lang", "k", "gram", "context", "kinds", "total", (F.col("n") / (F.col("total") + F.col("kinds"))).alias("chance")), "ppm-chances")
    # What was seen after a context was seen after the shorter one too, so its chance there needs no escape.
    shorter = chances.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("suffix"), F.col("chance").alias("below"))
    both = chances.withColumn("suffix", F.expr("gram & (CAST(power(256, k) AS LONG) - 1)")).join(shorter, ["lang", "k", "suffix"], "left")
    left = F.greatest(1 - F.sum(F.coalesce("below", F.lit(1 / 256))), F.lit(1e-12))
    escapes = both.groupBy("lang", "k", "context").agg((F.first("kinds") / (F.first("total") + F.first("kinds")) / left).alias("chance"))
    place = lambda context: F.when(F.col("k") >= 2, F.expr(f"{context} & 65535")).cast("int").alias("place")
    bits = (-F.log2(F.greatest("chance", F.lit(1e-30)))).cast("float").alias("bits")
    rows = chances.select("lang", "k", F.lit(False).alias("escape"), F.col("gram").alias("key"), bits, place("context"))
    table = stored(rows.union(escapes.select("lang", "k", F.lit(True).alias("escape"), F.col("context").alias("key"), bits, place("context"))), "ppm-model")
    return Model(languages, table, _ranges({r[0]: r[1] for r in table.where("place IS NOT NULL").groupBy("place").count().collect()}))  # at most 65,536 rows


def _ranges(counts: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of two bytes, together all of them, with at most ``SHARD`` rows each where a pair of bytes has no more by itself."""
    out, first, held = [], 0, 0
    for place in sorted(counts):
        if held and held + counts[place] > SHARD:
            out.append((first, place - 1))
            first, held = place, 0
        held += counts[place]
    return [*out, (first, 65535)]


def code_lengths(shard: Shard, languages: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the bytes of each text that belong to the shard, under each language."""
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), languages))
    if not len(data):
        return out
    text, at = _padded(data, offsets)
    wide = text.astype(np.uint32)
    keys = wide[at - 3] << 24 | wide[at - 2] << 16 | wide[at - 1] << 8 | wide[at]
    which, grams = pd.factorize(keys, sort=True)
    place = grams >> 8 & 0xFFFF
    mine = (place >= shard.first) & (place <= shard.last)
    some = np.flatnonzero(lengths)
    for i in range(languages):
        bits = np.zeros(len(grams))
        bits[mine] = shard.bits(grams[mine].astype(_U), i)
        out[some, i] = np.add.reduceat(bits[which], offsets[:-1][some])
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (share of the best language among all, equally likely before) and ``bits_per_byte`` of ``n_bytes``."""
    letters: Column = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), letters.alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    names = np.array([*model.languages, UNDETERMINED], object)
    count = len(model.languages)

    def judged(batch: pa.RecordBatch, bits: np.ndarray, n_bytes: np.ndarray) -> pa.RecordBatch:
        best, least = bits.argmin(1), bits.min(1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array(names[np.where(known, best, count)], pa.string()),
                "score": np.where(known, share, 0.0),
                "bits_per_byte": pa.array(least / np.maximum(n_bytes, 1), mask=~known),
                "n_bytes": n_bytes,
            }
        )

    def sent(i: int):
        return docs.sparkSession.sparkContext.broadcast(model.shard(i))

    if len(model.ranges) == 1:
        shared = sent(0)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                data, offsets = flat(batch.column("text"))
                yield judged(batch, code_lengths(shared.value, count, data, offsets), np.diff(offsets))

        return rows.mapInArrow(score, _SCORED)

    def partial(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                bits = code_lengths(shared.value, count, *flat(batch.column("text")))
                yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "bits": pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * count, pa.int32()), pa.array(bits.ravel()))})

        return run

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = np.array(batch.column("bits").to_pylist(), float).reshape(-1, count)
                yield judged(batch, bits, batch.column("n_bytes").to_numpy())

    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest")
    parts = []
    for i in range(len(model.ranges)):
        shared = sent(i)
        found = rows.select(digest, "text").mapInArrow(partial(shared), "digest binary, bits array<double>")
        parts.append(stored(found.groupBy("digest").agg(F.first("bits").alias("bits")), "ppm-bits"))  # equal texts have equal bits
        shared.destroy()
    merged = reduce(DataFrame.union, parts).groupBy("digest").agg(*[F.sum(F.get("bits", F.lit(i))).alias(f"b{i}") for i in range(count)])
    merged = stored(merged.select("digest", F.array(*[F.col(f"b{i}") for i in range(count)]).alias("bits")), "ppm-bits")
    keyed = rows.select("doc_id", "letters", digest, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return stored(keyed, "ppm-rows").join(merged, "digest").select("doc_id", "letters", "n_bytes", "bits").mapInArrow(total, _SCORED)


def keep_known(docs: DataFrame, languages: list[str] | None = None, excess: float = 64.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns; learned from ``lang_col`` of the same rows.

    Rejected are texts without a letter, texts that cost ``excess`` bits more under
    every model than plain bytes of eight bits (so a short text, which proves
    little, stays) and, where ``languages`` are given, texts in others.  Where nothing can be learned,
    nothing is rejected.  Longer contexts seen once are left out of these models: the texts they judge are
    those they learned from, and would vouch for themselves.
    """
    model = fit(docs, text_col, lang_col, least=2)
    if model is None:
        return docs
    wanted = (F.col("bits_per_byte") - 8) * F.col("n_bytes") < excess
    if languages is not None:
        wanted &= F.col("lang_pred").isin(languages)
    known = predict(docs, model, id_col, text_col).where(wanted & (F.col("lang_pred") != UNDETERMINED)).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(known, docs[id_col].eqNullSafe(known["__id"]), "left_semi").where(F.col(text_col).rlike(r"\p{L}"))
