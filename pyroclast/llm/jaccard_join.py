"""Exact n-gram Jaccard join, size-aware: subsets of small sets, inverted lists for large ones.

Two documents link when ``100 * |intersection| >= percent * |union|`` of their
sets of word shingles.

*Small sets* (up to ``boundary``) enumerate their subsets of fixed sizes: a set
of n shingles can lose at most ``n * (1 - percent)`` of them to a partner, and
two linked sets have exactly one common subset of the size of their
intersection.  *Large sets* are put on inverted lists.  A list for a single
frequent shingle would be as long as the table, so a list stands for a whole
range of the shingles' hash space: sets of similar size cut the space into more
ranges than they can have differences, so linked sets agree on some range in
full, and both are on its list.  The boundary is the largest size at which
enumerating is cheaper than scanning lists of ``SCAN`` entries.

Sets that are equal are one node from the start.  Lists are then scanned in two
rounds, neither of which emits the pairs of a group:

1. star: every node meets the least node of its list; links are verified, and
   connected components found;
2. what is left are lists with several components.  They are scanned in blocks
   (pairs of blocks, where a list has more than one), nodes of different
   components only.  A first scan, by sketches, keeps the nodes with any
   candidate; to these their sets are joined, and a second scan verifies the
   candidates where they meet and unites components as it goes, so a block
   gives at most one link for each component that it joins to another.

Before it is verified, a pair must pass a bound that never rejects a link: the
parities of hashed shingles (one bit each) can't differ in more places than the
sets do.  Shingles are compared by 64-bit hashes of their words.

Result: one row per document with the number of its shingles and its component.
Pairs inside a component aren't listed.

Edge cases: null and empty texts, or texts of white space, have no shingle,
link with nothing and are their own component; fewer words than a shingle make
one shingle; copies are one node, whatever their number; rows that repeat an id
are one row each, and components go by the least id; null ids take part and are
never the least; between steps a row goes by a hash of its id and text, and sets
go by their digests, never by ids; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.arrays import as_long, flat, mix, ragged, slices, to_binary
from pyroclast.llm.components import components
from pyroclast.llm.shingle_sets import shingles
from pyroclast.llm.storage import stored
from pyroclast.llm.tables import unused

WIDTH, PERCENT = 3, 90
#: Entries that scanning one inverted list is taken to cost, against one for emitting a subset.
SCAN = 4
#: Nodes, and bytes of their sets, that one block of a list has on average.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Lists that a sample of one node in ``ONE_IN`` shows to be longer are counted by aggregates instead of in one window.
HOT, ONE_IN = 16_384, 64
#: Node ids are sent to all tasks up to this number (16 MB), and joined by a shuffle beyond it.
BROADCAST_NODES = 2_000_000

_U = np.uint64
_SETS = "doc_id long, row long, n long, hi long, lo long, sketch binary"
_ENTRIES = "hi long, lo long, key long"


class Plan:
    """Sizes that can link, the size classes of the lists, and the boundary between the two ways."""

    def __init__(self, percent: int = PERCENT, scan: int = SCAN):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // percent)))
        self.edges = np.array(self.bounds, np.int64)
        self.ranges = np.array([self._ranges(j) for j in range(len(self.bounds) - 2)], np.int64)
        self.boundary = 1
        while self.subsets(self.boundary + 1) <= scan * self.lists(self.boundary + 1):
            self.boundary += 1
        self.overlap = self.boundary * 100 // percent  # sizes up to here enumerate too, to meet small sets

    def _ranges(self, j: int) -> int:
        """One more than there can be differences, and room for the ranges that stay empty by chance in the smallest sets."""
        least = ranges = self.differences(j) + 2
        for _ in range(20):
            filled = 1 - 1.4 * math.exp(-self.bounds[j] / ranges)
            if filled < 0.5:  # thresholds this low fill too few ranges; such sets meet on their common list
                return least
            ranges = math.ceil(least / filled)
        return ranges + ranges // 64

    def lost(self, n: int) -> int:
        """The most shingles of n that a linked set can lack."""
        return n * (100 - self.percent) // 100

    def allowed(self, n, m):
        """The most differences of linked sets of n and m shingles."""
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    def subsets(self, n: int) -> int:
        return sum(comb(n, i) for i in range(self.lost(n) + 1))

    def differences(self, j: int) -> int:
        """The most differences of two linked sets of class j, or of classes j and j + 1."""
        small = self.bounds[j + 1] - 1
        return int(self.allowed(small, min(self.bounds[j + 2] - 1, small * 100 // self.percent)))

    def lists(self, n: int) -> int:
        k = int(np.searchsorted(self.edges, n, "right")) - 1
        return int(self.ranges[k] + (self.ranges[k - 1] if k else 0))


@lru_cache(4)
def plan_of(percent: int) -> Plan:
    return Plan(percent)


def _sums(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(tokens + _U(0xA0761D6478BD642F)), out=out[1:])
    return out


def _subset_keys(plan: Plan, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key of every subset to enumerate; sets of one size are done together."""
    size = np.diff(at)
    of, keys = [], []
    with np.errstate(over="ignore"):
        for n in np.unique(size[(size > 0) & (size <= plan.overlap)]).tolist():
            sets = np.flatnonzero(size == n)
            h = mix(tokens[at[sets][:, None] + np.arange(n)] + _U(0xA0761D6478BD642F))
            whole = h.sum(1, dtype=_U)
            for gone in range(plan.lost(n) + 1):
                part = whole[:, None]
                if gone:
                    pick = np.array(list(_choose(n, gone)))
                    part = part - h[:, pick].sum(2, dtype=_U)
                keys.append(mix(part * _U(0x9E3779B97F4A7C15) + _U(n - gone)).ravel())
                of.append(np.repeat(sets, part.shape[1]))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(of), np.concatenate(keys)


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def _list_keys(plan: Plan, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set number and key of every inverted list that a large set is on.

    Empty ranges have no list.  A set with so many that the count of differences
    no longer leaves one (that is rare) is also listed by other hashes, and at
    last on one list for all such sets.
    """
    size = np.diff(at)
    large = np.flatnonzero(size > plan.boundary)
    of, keys = [], []
    k = np.searchsorted(plan.edges, size, "right") - 1
    for back in (0, 1):
        mine = large[k[large] >= back]
        scheme = k[mine] - back
        needed = np.array([plan.differences(j) + 1 for j in range(int(scheme.max(initial=-1)) + 1)], np.int64)
        for seed in range(3):
            if not len(mine):
                break
            a, some = at[mine], size[mine]
            doc = np.repeat(np.arange(len(mine)), some)
            h = tokens[ragged(a, some)]
            if seed:
                h = mix(h + _U(seed))
                h = h[np.lexsort((h, doc))]
            ranges = plan.ranges[scheme][doc].astype(_U)
            part = ((h >> _U(32)) * ranges >> _U(32)).astype(np.int64)
            first = np.ones(len(h), bool)
            first[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(first)
            sums = _sums(h)
            with np.errstate(over="ignore"):
                content = sums[np.append(start[1:], len(h))] - sums[start]
                place = (scheme[doc[start]].astype(_U) << _U(44)) + (_U(seed) << _U(40)) + part[start].astype(_U)
                keys.append(mix(content + mix(place + _U(0xE7037ED1A0B428DB))))
            of.append(mine[doc[start]])
            short = np.bincount(doc[start], minlength=len(mine)) < needed[scheme]
            mine, scheme = mine[short], scheme[short]
        of.append(mine)
        keys.append(mix(scheme.astype(_U) + _U(0x8EBC6AF09C88C6E3)))
    return (np.concatenate(of), np.concatenate(keys)) if of else (np.zeros(0, np.int64), np.zeros(0, _U))


def _sketches(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of the hashed shingles, 2 to 4 for each shingle of a set, end to end, and the bytes of each set."""
    size = np.diff(at)
    wide = np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) + 1)
    length = np.where(size > 0, 1 << (wide - 3), 0)
    start = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(size)), size)
    place = (mix(tokens + _U(0x589965CC75374CC3)) & (_U(1) << wide[doc].astype(_U)) - _U(1)).astype(np.int64)
    key, times = np.unique((start[doc] << 3) + place, return_counts=True)
    out = np.zeros(int(length.sum()), np.uint8)
    odd = key[times % 2 == 1]
    np.bitwise_or.at(out, odd >> 3, (1 << (odd & 7)).astype(np.uint8))
    return out, length


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places where rows of sketches differ; wider ones are folded first."""
    while a.shape[-1] != b.shape[-1]:
        if a.shape[-1] > b.shape[-1]:
            a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
        else:
            b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _new_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with the sizes and 128-bit digests of its sets, and the shingles of those that the task meets first (with their rows)."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, "text"):
        tokens, at = shingles(*flat(batch.column("text")), width)
        n = np.diff(at)
        hi, lo = _digests(tokens, at)
        own = []
        for i, pair in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
            if pair not in seen and n[i]:
                seen.add(pair)
                own.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        own = np.array(own, np.int64)
        yield batch, hi, lo, n, own, tokens[ragged(at[own], n[own])]


def set_rows(texts: DataFrame, width: int) -> DataFrame:
    """For each document the size and digest of its set, and for each set that a task meets first its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hi, lo, n, own, mine in _new_sets(batches, width):
            bits, length = _sketches(mine, np.concatenate([[0], np.cumsum(n[own])]))
            every = np.zeros(len(n), np.int64)
            every[own] = length
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n": n, "hi": hi, "lo": lo, "sketch": to_binary(bits, every)})

    return texts.mapInArrow(run, _SETS)


def list_entries(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """A row per set (the first in each task) and subset or list that it is on.

    There may be as many rows as half the shingles, so they go to the shuffle as
    they are made instead of into a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of(percent)
        for _, hi, lo, n, own, mine in _new_sets(batches, width):
            at = np.concatenate([[0], np.cumsum(n[own])])
            of, keys = (np.concatenate(x) for x in zip(_subset_keys(plan, mine, at), _list_keys(plan, mine, at), strict=True))
            row = own[of]
            yield pa.RecordBatch.from_pydict({"hi": hi[row], "lo": lo[row], "key": as_long(keys)})

    return texts.mapInArrow(run, _ENTRIES)


def _passing(percent: int):
    """Rows of a pair with both sketches, where the bound allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of(percent)
        for batch in batches:
            keep = []
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            for i, (s, t) in enumerate(zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                if int(differing(np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8))) <= plan.allowed(n[i], m[i]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _folded(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows of the least width among them."""
    data, at = flat(column.combine_chunks())
    least = int(np.diff(at).min())
    rows = np.empty((len(at) - 1, least), np.uint8)
    for i in range(len(rows)):
        s = data[at[i] : at[i + 1]]
        while len(s) > least:
            s = s[: len(s) // 2] ^ s[len(s) // 2 :]
        rows[i] = s
    return rows.view(np.uint64)


def _with_candidates(percent: int):
    """The nodes of a list, or of two blocks of it, that may link with one of another component there."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        plan = plan_of(percent)
        root, n, block = (table.column(c).to_numpy() for c in ("root", "n", "block"))
        rows = _folded(table.column("sketch"))
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        stay = np.zeros(len(root), bool)
        step = max(1, (4 << 20) // max(1, len(right) * rows.shape[1]))
        for a in range(0, len(left), step):
            x = left[a : a + step]
            i, j = np.nonzero((root[x][:, None] != root[right][None]) & (np.minimum(n[x][:, None], n[right]) * 100 >= np.maximum(n[x][:, None], n[right]) * percent))
            i, j = x[i], right[j]
            apart = np.bitwise_count(rows[i] ^ rows[j]).sum(1, dtype=np.int64)
            ok = apart <= plan.allowed(n[i], n[j])
            stay[i[ok]] = stay[j[ok]] = True
        return table.filter(pa.array(stay))

    return run


def _uniting(percent: int):
    """Links between nodes of two blocks of a list, one for each time that two components become one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        plan = plan_of(percent)
        node, n, block = (table.column(c).to_numpy() for c in ("node", "n", "block"))
        rows = _folded(table.column("sketch"))
        data, at = flat(table.column("set").combine_chunks())
        at = at // 8
        shingle, number = np.unique(data.view(_U), return_inverse=True)
        component = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        own = np.zeros(len(shingle), bool)
        found_a, found_b = [], []
        for x in left.tolist():
            some = right[(component[right] != component[x]) & (np.minimum(n[x], n[right]) * 100 >= np.maximum(n[x], n[right]) * percent)]
            some = some[np.bitwise_count(rows[x] ^ rows[some]).sum(1, dtype=np.int64) <= plan.allowed(n[x], n[some])]
            if not len(some):
                continue
            own[number[at[x] : at[x + 1]]] = True
            before = np.concatenate([[0], np.cumsum(n[some])])
            both = np.add.reduceat(own[number[ragged(at[some], n[some])]], before[:-1], dtype=np.int64)
            own[number[at[x] : at[x + 1]]] = False
            linked = some[100 * both >= percent * (n[x] + n[some] - both)]
            other, first = np.unique(component[linked], return_index=True)
            found_a += [int(node[x])] * len(other)
            found_b += node[linked[first]].tolist()
            component[np.isin(component, other)] = component[x]
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (s, t) in enumerate(zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                x, y = np.frombuffer(s, _U), np.frombuffer(t, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("s")), sets.select(F.col("node").alias("b"), F.col("set").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _digests(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    with np.errstate(over="ignore"):
        sums, other = _sums(tokens), np.zeros(len(tokens) + 1, _U)
        np.cumsum(mix(tokens ^ _U(0x1D8E4E27C47D124F)), out=other[1:])
        hi = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(_U)).view(np.int64)
        lo = (other[at[1:]] - other[at[:-1]]).view(np.int64)
    return hi, lo


def _sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The sets of ``nodes`` (node, row, hi, lo), from the texts of their rows; of each node the set with its digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            tokens, at = shingles(*flat(batch.column("text")), width)
            hi, lo = _digests(tokens, at)
            node = batch.column("node").to_numpy()
            own = []
            for i in np.flatnonzero((hi == batch.column("hi").to_numpy()) & (lo == batch.column("lo").to_numpy())).tolist():
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    own.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            own = np.array(own, np.int64)
            n = np.diff(at)[own]
            yield pa.RecordBatch.from_pydict({"node": node[own], "set": to_binary(tokens[ragged(at[own], n)].view(np.uint8), 8 * n)})

    few = nodes.count() <= BROADCAST_NODES
    return texts.join(F.broadcast(nodes) if few else nodes, "row").select("node", "hi", "lo", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def _row(id_: Column, text: Column) -> Column:
    """What a row goes by: two with different ids or texts have the same with a chance of 2^-64."""
    return F.xxhash64(id_.cast("long"), text)


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links."""
    rows, of_node = _linked(docs, width, percent, id_col, text_col)
    found = rows.where("n > 0").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n, node), and for each node the first row of its component (node, head), by id and then row, null ids last."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", _row(F.col("doc_id"), F.col("text")))
    rows = stored(set_rows(texts, width), "jaccard-sets")

    # 128-bit digests tell sets apart; should two share the first half, the second one joins in for those.
    heads = stored(rows.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("head"), F.first("n").alias("n"), F.max("sketch").alias("sketch")), "jaccard-heads")
    clash = heads.groupBy("hi").count().where("count > 1").select("hi")
    if clash.isEmpty():
        named = lambda df: df.withColumnRenamed("hi", "node")
    else:
        other = clash.withColumn("clash", F.lit(True))
        named = lambda df: df.join(other, "hi", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("hi", "lo")).otherwise(F.col("hi")))
    entries = named(list_entries(texts, width, percent)).select("node", "key")
    nodes = named(heads.withColumn("high", F.col("hi"))).select("node", "high", "lo", "head", "n", "sketch")

    # Lists with the same nodes are one: a list is named by the sum of its nodes' hashes, their number and the least.
    about = lambda over: (over(F.min("node")).alias("least"), over(F.max("node")).alias("most"), over(F.sum(F.expr("CAST(xxhash64(node) AS DECIMAL(20,0))"))).alias("sum"), over(F.count("*")).alias("count"))
    few = list_entries(texts.where(F.pmod(F.xxhash64("text", F.lit(ONE_IN)), F.lit(ONE_IN)) == 0), width, percent).distinct().groupBy("key").count()
    hot = stored(few.where(F.col("count") >= HOT // ONE_IN).select("key"), "jaccard-hot-lists")
    some = hot.count()
    cold = entries
    if some:
        marked = F.broadcast(hot) if some <= BROADCAST_NODES else hot
        cold = entries.join(marked, "key", "left_anti")
        hottest = stored(entries.join(marked, "key", "left_semi").distinct(), "jaccard-hot-entries")
    own = Window.partitionBy("key")
    listed = cold.select("node", *about(lambda c: c.over(own)))
    if some:
        counted = stored(hottest.groupBy("key").agg(*about(lambda c: c)), "jaccard-hot-counts")
        listed = listed.union(hottest.join(F.broadcast(counted) if some <= BROADCAST_NODES else counted, "key").select(listed.columns))
    listed = listed.where("least < most").select(F.xxhash64("sum", "count", "least").alias("list"), "least", "node").distinct()
    lists = stored(listed, "jaccard-lists")

    involved = stored(lists.select("node").distinct().join(nodes, "node"), "jaccard-nodes")
    small = involved.select("node", "n", "sketch")
    sets = stored(_sets_of(texts, involved.select("node", F.col("head.row").alias("row"), F.col("high").alias("hi"), "lo"), width), "jaccard-texts")

    stars = lists.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(small.select(F.col("node").alias("a"), "n", F.col("sketch").alias("s")), "a").join(small.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t")), "b")
    stars = stars.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).mapInArrow(_passing(percent), "a long, b long")
    links = stored(_verify(stars, sets, percent), "jaccard-links")
    roots = components(links)

    rooted = lists.select("list", "node").join(roots, "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.join(small.select("node", "n"), "node").groupBy("list").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("shingles") / BLOCK_BYTES)).cast("int")
    members = rooted.join(open_.select("list", blocks.alias("blocks")), "list").join(small, "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("list", "node", "root", "n", "sketch", "block", other).select("list", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "root", "n", "block", "sketch")
    near = stored(members.groupBy("list", "one", "two").applyInArrow(_with_candidates(percent), members.schema), "jaccard-near")
    more = stored(near.join(sets, "node").groupBy("list", "one", "two").applyInArrow(_uniting(percent), "a long, b long").distinct(), "jaccard-links")
    roots = components(links.union(more))

    # The first row of each component, by node first: copies of a text meet in one small row.
    first = nodes.select("node", "head").join(roots, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    of_root = first.groupBy("root").agg(F.min("head").alias("head"))
    of_node = first.select("node", "root").join(of_root, "root").select("node", "head")
    return named(rows).select("doc_id", "row", "n", "node"), of_node


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, that with the least id; rows without a shingle all stay.

    Among rows of the least id (or of none, where all ids are null) with
    different texts the choice goes by a hash of the text; of rows that repeat id
    and text any one stays.
    """
    rows, of_node = _linked(docs, width, percent, id_col, text_col)
    row = unused(docs, "row")
    stay = stored(of_node.select(F.col("head.row").alias(row)).distinct(), "jaccard-stay")
    alone = rows.where("n = 0").select(F.col("row").alias(row)).distinct()
    often = stored(rows.where("n > 0").select(F.col("row").alias(row)).join(stay, row).groupBy(row).count().where("count > 1").select(row), "jaccard-often")
    keyed = docs.withColumn(row, _row(F.col(id_col), F.col(text_col)))
    if often.isEmpty():
        return keyed.join(stay.union(alone), row, "left_semi").select(docs.columns)
    kept = keyed.join(stay.join(often, row, "left_anti").union(alone), row, "left_semi")
    return kept.union(keyed.join(often, row, "left_semi").dropDuplicates([row])).select(docs.columns)
