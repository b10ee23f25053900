"""Importance resampling: the documents whose hashed word runs are most like a target's are drawn.

A feature is a run of 1 to ``n`` words joined by one space, and its bucket is the
CRC of its bytes modulo ``buckets``.  One scan of a document keeps a ring of
running CRC states, one for each of the last ``n`` starts: a word is put after a
space to each of them and begins a new one, and every state is a feature, so no
run is ever built.  Long texts pass through the scan in segments, and the ring
goes on from one to the next.

The scan writes each document's buckets (sorted, as differences, about a byte a
feature), from which the corpus counts and then the weights are taken, so texts
are read once.  Between these two stands a table of ``buckets`` numbers: the gains

    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))

of the counts t of T in the target and s of S in the corpus.  Their number is a
parameter and doesn't grow with the data, so they are sent to every task.

The draw takes the highest of weight + Gumbel noise (hashed from the id), that is a draw
without replacement.  Ranks come from one range sort: a row's rank is its place
in its partition behind the sizes of the partitions before, so no task sees more
than one range; equal keys are told apart by the row's number and can be split.

Edge cases: null and empty texts have no features, weight 0 and no rank; a null
id is hashed as an empty string and comes last among equal scores; repeated rows
count and are drawn one by one; an empty target gives each bucket what its
absence tells; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.arrays import slices
from pyroclast.llm.storage import stored

#: Bytes of a text that the scan has in hand as words.
SEGMENT = 1 << 20
#: Letters A to Z become small, other letters, digits and bytes from 128 stay, the rest parts words.
_CLEAN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def segments(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes of it at a time; no word is cut."""
    if len(text) <= size:
        yield text.translate(_CLEAN).split()
        return
    held = b""
    for at in range(0, len(text), size):
        part = held + text[at : at + size].translate(_CLEAN)
        cut = part.rfind(b" ") + 1
        yield part[:cut].split()
        held = part[cut:]
    yield held.split()


def scan(text: bytes, n: int, buckets: int, size: int | None = None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature in no order."""
    count, ring, found = 0, [], []
    older = max(0, n - 1)
    for words in segments(text, size or SEGMENT):
        states: list[int] = []
        for word in words:
            after = b" " + word
            ring = [crc32(word), *[crc32(after, state) for state in ring[:older]]]
            states += ring
        count += len(words)
        found.append((np.array(states, np.uint32) % buckets).astype(np.uint32))
    return count, np.concatenate(found)


def packed(places: np.ndarray) -> bytes:
    """Sorted numbers as differences: 255 for each whole 255, then the rest."""
    if not len(places):
        return b""
    step = np.diff(np.sort(places).astype(np.int64), prepend=0)
    many = step // 255
    out = np.full(int(many.sum()) + len(step), 255, np.uint8)
    out[np.cumsum(many + 1) - 1] = step % 255
    return out.tobytes()


def unpacked(data: np.ndarray) -> np.ndarray:
    """The sorted numbers again."""
    return np.cumsum(data, dtype=np.int64)[data != 255]


def features(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int) -> DataFrame:
    """Written rows ``doc_id``, n_words, n_features, places (packed buckets) and row, a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, many, places = [], [], []
            for text in batch.column("text"):
                count, found = scan(text.as_buffer().to_pybytes() if text.is_valid else b"", n, buckets)
                words.append(count)
                many.append(len(found))
                places.append(packed(found))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(many, pa.int64()), "places": pa.array(places, pa.binary())})

    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = told.schema["doc_id"].dataType.simpleString()
    found = told.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, places binary")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "features")


def counts(found: DataFrame, buckets: int) -> DataFrame:
    """bucket and how many features are in it; a task gives one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for places in batch.column("places"):
                total += np.bincount(unpacked(np.frombuffer(places.as_buffer(), np.uint8)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    return found.where("n_features > 0").select("places").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; two tables of at most ``buckets`` counts."""
    s, t = (df.select("bucket", F.col("n").alias(k)) for df, k in ((corpus, "s"), (target, "t")))
    number = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    told = number.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    every = Window.partitionBy()  # over `buckets` rows
    s, t, all_s, all_t = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(every), F.sum("t").over(every)))
    gain = F.floor(1000 * F.ln(((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))))
    return told.select("bucket", gain.cast("long").alias("gain")).toPandas().sort_values("bucket")["gain"].to_numpy(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with weight, the floored mean gain of its features, instead of places."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(shared.value[unpacked(np.frombuffer(p.as_buffer(), np.uint8))].sum()) // n if n else 0 for p, n in zip(batch.column("places"), batch.column("n_features").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features", "row")), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "row", "weight"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, row long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3 … in this order, null beyond ``limit``. The order has to tell all rows apart."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each partition
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn("part", part).join(F.broadcast(start), "part").withColumn("rank", rank)
    return found.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank"))).drop("part", "at", "start")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if it is among the ``percent`` drawn, its rank.

    Only documents of at least ``least_words`` words can be drawn, and only they are counted for the share.
    """
    if n < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("n and buckets are at least 1, percent is between 0 and 100")
    corpus = features(docs, id_col, text_col, n, buckets)
    aim = features(target.withColumn("_", F.lit(0)), "_", target_col, n, buckets)
    gain = gains(counts(corpus, buckets), counts(aim, buckets), buckets)
    scored = stored(weighed(corpus, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    enough = F.col("n_words") >= least_words
    limit = scored.where(enough).count() * percent // 100
    drawn = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], limit)
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
