"""Finding every window of units (bytes or words) that occurs more than once, exactly and without shuffling all of them.

The steps narrow down where a repeated window can be by grouping hashes; whether
it repeats is decided by a ``solver`` that compares contents in bounded shards: see
:mod:`~pyroclast.llm.suffix_dedup` and :mod:`~pyroclast.llm.substring_dedup`.

1. *Spans.*  In every window the gram (``gram`` units) with the least hash is its
   anchor.  Equal windows have equal anchors at the same place, and neighbouring
   windows share theirs, so a document becomes few spans: the run of windows
   with one anchor.  A window can repeat only where its anchor's gram does.
2. *Stretches.*  Of a span that seems to occur twice as a whole, two places go to
   a shard.  Neighbouring spans with the same two places go as one stretch.
3. *Parts.*  Spans that share a gram and differ are cut by their windows' distance
   from the anchor into parts of at most ``step`` windows.  These have
   ``width - step + 1`` units in common, their core.  Parts go to a shard by core,
   two of each content, where a core has more than one.
4. *Shorter parts.*  A core with more than ``shard`` parts would not fit there.  Its
   parts are cut again by a quarter of the step, down to single windows.

What is grouped are 64-bit hashes with places; units move only to the shards, and
the rest of a group shares the decision about its two.  Groups are
counted by Spark's two-stage aggregates, and no group is gathered but the bounded
shards and the places of one document.  Of a very long text ``SEGMENT`` units are
hashed at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.arrays import as_long, flat, mix, prefix_hash, ragged, slice_hash, slice_hashes, slices, to_binary
from pyroclast.llm.storage import stored

#: Parts that one shard holds on average, and that one core may have there.
SHARD = 4096
#: Units of stretches that one shard holds on average, and windows of one stretch.
STRETCH_UNITS, STRETCH = 1 << 19, 1 << 16
#: Units of one text that are hashed at a time.
SEGMENT = 1 << 20
#: Lists by document are sent to all tasks up to this number of rows and of entries (150 MB at most), and joined by a shuffle beyond it.
BROADCAST_ROWS, BROADCAST_ENTRIES = 400_000, 2_000_000
_SEGMENT = 1 << 23
#: Bytes of text that a task hashes at a time; each takes about 120 bytes while it does.
_CHUNK = 1 << 20
_U = np.uint64


class Shape(NamedTuple):
    """Units of a window, of an anchor's gram, and windows of a part."""

    width: int
    gram: int
    step: int


class Method(NamedTuple):
    """What differs between bytes and words.

    ``read`` gives the units of texts and where each text's begin.  ``values``
    hashes units, each with the ``ahead`` units after it.  ``solve`` tells, from contents (one
    array of units, with offsets), whether each window of each content occurs
    twice among them.
    """

    read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    values: Callable[[np.ndarray], np.ndarray]
    ahead: int
    solve: Callable[[np.ndarray, np.ndarray, Shape], np.ndarray]
    unit: np.dtype


class Spans(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least key of each ``width`` keys by its upper 40 bits, the leftmost of equal ones."""
    out = np.empty(max(0, len(keys) - width + 1), np.int64)
    for a in range(0, len(out), _SEGMENT):
        some = keys[a : a + _SEGMENT + width - 1]
        least, reach = (some & ~_U((1 << 24) - 1)) | np.arange(len(some), dtype=_U), 1  # the least of ``reach`` keys from each on
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        n = len(some) - width + 1
        least = np.minimum(least[:n], least[width - reach : width - reach + n])
        out[a : a + n] = (least & _U((1 << 24) - 1)).astype(np.int64) + a
    return out


def spans(units: np.ndarray, offsets: np.ndarray, shape: Shape, method: Method) -> Spans:
    count = np.maximum(np.diff(offsets) - shape.width + 1, 0)
    window = ragged(offsets[:-1], count)
    if not len(window):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none, none.view(_U), none.view(_U))
    n = len(units)
    sums = prefix_hash(method.values(units))
    grams = slice_hashes(sums, shape.gram - method.ahead)[: n - shape.gram + 1]
    anchor = leftmost_least(grams, shape.width - shape.gram + 1)[window]
    doc = np.repeat(np.arange(len(count)), count)
    first = np.ones(len(window), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    start, size = window[at], np.diff(np.append(at, len(window)))
    anchor = anchor[at]
    whole = mix(slice_hash(sums, start, start + size - 1 + shape.width - method.ahead) + (anchor - start).astype(_U))
    return Spans(doc[at], start - offsets[doc[at]], size, anchor - start, grams[anchor], whole)


def segmented(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last unit and offsets of what is hashed at a time: the batch, or parts of it that share ``width - 1`` units."""
    n = int(offsets[-1])
    if n <= 2 * SEGMENT:
        yield 0, n, offsets
        return
    for doc in range(len(offsets) - 1):
        for a in range(int(offsets[doc]), max(int(offsets[doc]) + 1, int(offsets[doc + 1]) - width + 1), SEGMENT):
            b = min(a + SEGMENT + width - 1, int(offsets[doc + 1]))
            yield a, b, np.concatenate([np.zeros(doc + 1, np.int64), np.full(len(offsets) - 1 - doc, b - a)])


class Parts(NamedTuple):
    """Parts of spans: which span, first window in it, number of windows, hashes of core and content."""

    span: np.ndarray
    lo: np.ndarray
    windows: np.ndarray
    core: np.ndarray
    content: np.ndarray


def parts(sums: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, shape: Shape, ahead: int) -> Parts:
    """``start`` counts from the batch's first unit, ``anchor`` from the span's start."""
    nearest, furthest = anchor - windows + 1, anchor
    least, most = nearest // shape.step, furthest // shape.step
    many = most - least + 1
    span = np.repeat(np.arange(len(start)), many)
    case = ragged(least, many)
    a = (start + anchor)[span]
    # A window at distance o from its anchor is in case o // step; distances fall as windows go on.
    lo = np.maximum(anchor[span] - (case + 1) * shape.step + 1, 0)
    hi = np.minimum(anchor[span] - case * shape.step, windows[span] - 1)
    core = slice_hash(sums, a - case * shape.step, a - (case + 1) * shape.step + 1 + shape.width - ahead)
    begin = start[span] + lo
    content = slice_hash(sums, begin, start[span] + hi + shape.width - ahead)
    away = (a - begin).astype(_U)
    return Parts(span, lo, hi - lo + 1, mix(core + case.astype(_U)), mix(content + away * _U(0x9E3779B97F4A7C15)))


def _fits(rows: DataFrame, lists: str) -> DataFrame:
    n, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and entries <= BROADCAST_ENTRIES else rows


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and a ``key`` that tells rows of different id or text apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.withColumn("key", F.xxhash64("doc_id", "text"))


def _nested(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number and fields of the structs in a list column."""
    lists = batch.column(column)
    many = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    structs = lists.flatten()
    return np.repeat(np.arange(len(lists)), many), {f.name: structs.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(structs.type)}


def _span_rows(method: Method, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _CHUNK):
            units, offsets = method.read(batch.column("text"))
            for a, b, own in segmented(offsets, shape.width):
                s = spans(units[a:b], own, shape, method)
                at = s.start + (a - offsets[s.doc] if len(own) and b - a < len(units) else 0)
                yield pa.RecordBatch.from_pydict(
                    {"key": batch.column("key").take(pa.array(s.doc)), "at": at.astype(np.int32), "windows": s.windows.astype(np.int32), "anchor": s.anchor.astype(np.int32), "gram": as_long(s.gram), "whole": as_long(s.whole)}
                )

    return run


def _part_rows(method: Method, shape: Shape):
    """Parts of the spans listed in ``spans``; ``base`` is how many windows of its whole come before a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _CHUNK):
            units, offsets = method.read(batch.column("text"))
            row, f = _nested(batch, "spans")
            begin, windows = offsets[row] + f["at"], f["windows"].astype(np.int64)
            order = np.argsort(begin, kind="stable")
            done = 0
            while done < len(order):
                # Spans that begin within a segment; their anchors and windows end soon after it.
                first = int(begin[order[done]])
                some = order[done : np.searchsorted(begin[order], first + SEGMENT)]
                done += len(some)
                last = int((begin[some] + windows[some]).max()) + 2 * shape.width
                sums = prefix_hash(method.values(units[first:last]))
                p = parts(sums, begin[some] - first, windows[some], f["anchor"][some].astype(np.int64), shape, method.ahead)
                span = some[p.span]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").take(pa.array(row[span])),
                        "at": (f["at"][span] + p.lo).astype(np.int32),
                        "whole": f["whole"][span],
                        "lo": (f["base"][span] + p.lo).astype(np.int32),
                        "windows": p.windows.astype(np.int32),
                        "anchor": (f["anchor"][span] - p.lo).astype(np.int32),
                        "core": as_long(p.core),
                        "content": as_long(p.content),
                    }
                )

    return run


def _content_rows(method: Method, shape: Shape):
    """The units of what is listed in ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _CHUNK):
            units, offsets = method.read(batch.column("text"))
            row, f = _nested(batch, "spans")
            begin, size = offsets[row] + f["at"], f["windows"].astype(np.int64) - 1 + shape.width
            # About a megabyte of contents at a time.
            step = np.cumsum(size) // SEGMENT
            for k in np.unique(step):
                some = np.flatnonzero(step == k)
                data = units[ragged(begin[some], size[some])].view(np.uint8)
                yield pa.RecordBatch.from_pydict({"one": f["one"][some], "two": f["two"][some], "side": f["side"][some], "windows": f["windows"][some], "shard": f["shard"][some], "units": to_binary(data, size[some] * method.unit.itemsize)})

    return run


def _by_text(texts: DataFrame, wanted: DataFrame, fields: list[str], run, schema: str) -> DataFrame:
    """Apply ``run`` to the texts of the keys of ``wanted``, each with its rows as a list ``spans``."""
    lists = stored(wanted.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("spans")), "repeats-wanted")
    # A key that repeats is one text; any of its rows will do.
    return texts.join(_fits(lists, "spans"), "key").mapInArrow(run, schema)


def _solved(method: Method, shape: Shape):
    """Runs (lo, hi) of windows that repeat in a shard, for each content (one, two)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, at = flat(table.column("units").combine_chunks())
        units = np.frombuffer(data.tobytes(), method.unit)
        yes = method.solve(units, at // method.unit.itemsize, shape)
        windows = table.column("windows").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(windows)), windows)
        window = ragged(np.zeros(len(windows), np.int64), windows)
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (yes[1:] != yes[:-1])
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:] - 1
        keep = yes[first] & (table.column("side").to_numpy()[row[first]] == 0)
        first, last = first[keep], last[keep]
        one, two = (table.column(c).to_numpy()[row[first]] for c in ("one", "two"))
        return pa.table({"one": one, "two": two, "first": window[first].astype(np.int32), "last": window[last].astype(np.int32)})

    return run


def _decided(texts: DataFrame, contents: DataFrame, method: Method, shape: Shape) -> DataFrame:
    """What the solver says of ``contents`` (one, two, side, shard, key, at, windows); sides but the first are there to be met."""
    schema = "one long, two long, side int, windows int, shard int, units binary"
    filled = _by_text(texts, contents, ["one", "two", "side", "shard", "at", "windows"], _content_rows(method, shape), schema)
    # Rows that repeat an id and a text give the same contents again.
    filled = stored(filled.dropDuplicates(["one", "two", "side"]), "repeats-filled")
    return filled.groupBy("shard").applyInArrow(_solved(method, shape), "one long, two long, first int, last int")


def _stretched(texts: DataFrame, wholes: DataFrame, method: Method, shape: Shape) -> DataFrame:
    """Windows (whole, lo, hi) of spans that occur twice as a whole."""
    pairs = wholes.where("times > 1").select("whole", F.col("one.key").alias("key"), F.col("two.key").alias("other"), F.col("one.at").alias("at"), (F.col("two.at") - F.col("one.at")).alias("shift"), F.col("one.windows").alias("windows"))
    pairs = pairs.withColumn("block", F.floor(F.col("at") / STRETCH))
    # Spans of one document with the same other document and shift, in order: never more than a text has.
    order = Window.partitionBy("key", "other", "shift", "block").orderBy("at")
    new = F.coalesce((F.col("at") != F.lag(F.col("at") + F.col("windows")).over(order)).cast("int"), F.lit(1))
    runs = pairs.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy("key", "other", "shift", "block", "run").agg(F.min("at").alias("at"), F.sum("windows").cast("int").alias("windows"), F.collect_list(F.struct("whole", "at", "windows")).alias("inner"))
    runs = stored(runs.withColumn("one", F.xxhash64("key", "at")).withColumn("two", F.xxhash64("other", "shift", "block", "run")), "repeats-stretches")
    units = runs.agg(F.coalesce(F.sum(2 * (F.col("windows") + shape.width)), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("one", "two"), F.lit(-(-units // STRETCH_UNITS) or 1)).cast("int").alias("shard")
    sides = runs.select("one", "two", F.lit(0).alias("side"), shard, "key", "at", "windows").union(runs.select("one", "two", F.lit(1), shard, "other", F.col("at") + F.col("shift"), "windows"))
    twice = _decided(texts, sides, method, shape)
    found = twice.join(runs.select("one", "two", F.col("at").alias("begin"), "inner"), ["one", "two"]).select("begin", "first", "last", F.explode("inner").alias("span"))
    offset = F.col("span.at") - F.col("begin")
    found = found.select("span.whole", F.greatest(F.col("first") - offset, F.lit(0)).alias("lo"), F.least(F.col("last") - offset, F.col("span.windows") - 1).alias("hi"))
    return found.where("lo <= hi")


def repeated(texts: DataFrame, method: Method, shape: Shape, shard: int = SHARD) -> DataFrame:
    """For each key of ``texts`` (:func:`keyed`) with repeats: arrays ``starts`` and ``ends`` of stretches of units to remove."""
    rows = stored(texts.mapInArrow(_span_rows(method, shape), "key long, at int, windows int, anchor int, gram long, whole long"), "repeats-spans")
    # Counts are written before they are joined: two plain exchanges are what adaptive execution can split at a hot key.
    often = stored(rows.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"), "repeats-grams")
    rows = stored(rows.join(often, "gram"), "repeats-candidates")

    place = F.struct("key", "at", "windows", "anchor")
    wholes = stored(rows.groupBy("gram", "whole").agg(F.count("*").alias("times"), F.min(place).alias("one"), F.max(place).alias("two")), "repeats-wholes")
    found = [_stretched(texts, wholes, method, shape)]
    contested = stored(wholes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram"), "repeats-contested-grams")
    wanted = wholes.join(contested, "gram").select("one.*", "whole", F.lit(0).alias("base"))

    schema = "key long, at int, whole long, lo int, windows int, anchor int, core long, content long"
    while True:
        cut = _by_text(texts, wanted, ["at", "windows", "anchor", "whole", "base"], _part_rows(method, shape), schema)
        cut = stored(cut.dropDuplicates(["whole", "lo"]), "repeats-parts")
        place = F.struct("whole", "lo", "key", "at", "windows")
        contents = stored(cut.groupBy("core", "content").agg(F.count("*").alias("times"), F.min(place).alias("one"), F.max(place).alias("two")), "repeats-contents")
        sizes = contents.groupBy("core").agg(F.sum(F.least("times", F.lit(2))).alias("sent")).where("sent > 1")
        sizes = stored(sizes, "repeats-cores")
        most = shard if shape.step > 1 else 2  # a single window is its own core, and two of it are sent
        large = sizes.where(F.col("sent") > most).select("core")
        fit = sizes.where(F.col("sent") <= most)
        shards = -(-(fit.agg(F.sum("sent")).first()[0] or 0) // shard) or 1
        fit = contents.join(fit, "core")
        number = F.pmod(F.xxhash64("core"), F.lit(shards)).cast("int").alias("shard")
        sides = fit.select(F.col("core").alias("one"), F.col("content").alias("two"), F.lit(0).alias("side"), number, "one.key", "one.at", "one.windows")
        sides = sides.union(fit.where("times > 1").select("core", "content", F.lit(1), number, "two.key", "two.at", "two.windows"))
        twice = _decided(texts, sides, method, shape).withColumnsRenamed({"one": "core", "two": "content"})
        found.append(cut.join(twice, ["core", "content"]).select("whole", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi")))
        if large.isEmpty():
            break
        wanted = cut.join(large, "core").select("key", "at", "windows", "anchor", "whole", F.col("lo").alias("base"))
        shape = shape._replace(step=max(1, shape.step // 4))

    windows = stored(reduce(DataFrame.unionByName, found), "repeats-found")
    places = rows.select("key", "at", "whole").join(windows, "whole")
    start: Column = (F.col("at") + F.col("lo")).cast("long")
    end = (F.col("at") + F.col("hi") + shape.width).cast("long")
    # Rows that repeat an id and a text have the same places, which a set keeps once.
    pieces = places.select("key", F.struct(start.alias("a"), end.alias("b")).alias("x")).groupBy("key").agg(F.collect_set("x").alias("x"))
    return pieces.mapInArrow(_merged, "key long, starts array<long>, ends array<long>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches that overlap or touch become one."""
    for batch in batches:
        row, f = _nested(batch, "x")
        far = int(f["b"].max(initial=0)) + 1
        order = np.lexsort((f["a"], row))
        row, a, b = row[order], f["a"][order], f["b"][order]
        reach = np.maximum.accumulate(b + row * far)
        first = np.ones(len(a), bool)
        first[1:] = a[1:] + row[1:] * far > reach[:-1]
        first[1:] |= row[1:] != row[:-1]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(a)) - 1
        edges = pa.array(np.searchsorted(row[at], np.arange(batch.num_rows + 1)).astype(np.int32))
        ends = reach[last] - row[last] * far
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "starts": pa.ListArray.from_arrays(edges, pa.array(a[at])), "ends": pa.ListArray.from_arrays(edges, pa.array(ends))})


def with_repeats(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``texts`` with what :func:`repeated` has for them."""
    return texts.join(_fits(stored(found, "repeats-pieces"), "starts"), "key", "left")


def marks(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
    """For each unit of a batch of :func:`with_repeats`, whether it is to be removed."""
    depth = np.zeros(int(offsets[-1]) + 1, np.int64)
    for column, sign in (("starts", 1), ("ends", -1)):
        lists = batch.column(column)
        many = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offsets[:-1], many)
        np.add.at(depth, place, sign)
    return np.cumsum(depth[:-1]) > 0
