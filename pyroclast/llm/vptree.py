"""Nearest neighbours by vantage-point trees, one per shard of rows.

Equal vectors collapse into one point with its k + 1 smallest ids, which no
search for k neighbours can tell from all of them, so a vector that a third of
all rows share is one point.  Points are dealt to cells: ``pivots`` of them
(``MOST_PIVOTS`` at most, those with the least hash) are centres, and a point
belongs to its nearest one.  A cell of more than ``shard_rows`` points is cut by
hash into several shards.  Each shard is a vantage-point tree, built once and
written: a node keeps the distance mu that halves its points by nearness to its
vantage point.  A query at distance d from that point, whose k-th best so far is
tau, must look beyond the shell if |d - mu| <= tau (triangle inequality).
``factor`` relaxes the pruning: the far side is skipped once |d - mu| > factor *
tau.  Factor one restores exact search; a smaller one skips more.

A query visits the shards of its own cell first.  Its k-th best there bounds
which other cells' shards it must visit: those whose centre is at most factor *
tau and the cell's covering radius away, by the same inequality.  A task holds one
shard and one block of ``block_rows`` queries.  The k best of all visits follow
by one grouped step.

Edge cases: vectors that are null, zero, of another length than the most usual
one, or hold null or non-finite components take no part; ties go to the smaller
id; rows that repeat an id and vector count once, and an id with several vectors is a candidate by each;
of queries that repeat an id the least vector is searched; fewer than k candidates give
all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pyroclast.llm.storage import stored

SHARD_ROWS = 16_384
BLOCK_ROWS = 16_384
#: Centres of cells that are sent to all tasks.
MOST_PIVOTS = 4096
LEAF = 48
_FOUND = "query_id long, vec_id long, score double"


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector can take part, as arrays of doubles."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn(vec_col, v.cast("array<double>"))


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(-1))


class Tree:
    """A vantage-point tree as arrays: points in the order of the leaves, and for each node its points' range, vantage point, mu and children.

    A node without a vantage point (-1) is a leaf; nodes whose points can't be halved stay leaves.
    """

    def __init__(self, points: np.ndarray):
        rng = np.random.default_rng(0)
        self.order = np.arange(len(points))
        nodes = [[0, len(points), -1, -1, -1]]
        mus, at = [0.0], 0
        while at < len(nodes):
            lo, hi = nodes[at][:2]
            rows = self.order[lo:hi]
            if hi - lo > LEAF:
                tried = rng.choice(rows, 4, replace=False)
                spreads = [distances(points[rows], points[t]) for t in tried]
                best = int(np.argmax([d.std() for d in spreads]))
                d, mu = spreads[best], float(np.median(spreads[best]))
                inside = d <= mu
                if not inside.all():
                    self.order[lo:hi] = np.concatenate([rows[inside], rows[~inside]])
                    cut = lo + int(inside.sum())
                    nodes[at][2:] = [int(tried[best]), len(nodes), len(nodes) + 1]
                    mus[at] = mu
                    nodes += [[lo, cut, -1, -1, -1], [cut, hi, -1, -1, -1]]
                    mus += [0.0, 0.0]
            at += 1
        self.nodes, self.mu = np.array(nodes, np.int64), np.array(mus)


class Search:
    """The k best points for a block of queries; ties to the smaller number of the point."""

    def __init__(self, points: np.ndarray, tree: Tree, queries: np.ndarray, k: int, factor: float):
        self.points, self.tree, self.queries, self.k, self.factor = points, tree, queries, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.row = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visited = 0
        self._go(0, np.arange(len(queries)))

    def _leaf(self, rows: np.ndarray, of: np.ndarray) -> None:
        step = max(1, (1 << 21) // max(1, len(rows) * self.points.shape[1]))
        for a in range(0, len(of), step):
            q = of[a : a + step]
            d = distances(self.points[rows][None], self.queries[q][:, None])
            self.visited += d.size
            d = np.concatenate([self.best[q], d], axis=1)
            r = np.concatenate([self.row[q], np.broadcast_to(rows, (len(q), len(rows)))], axis=1)
            order = np.lexsort((r, d))[:, : self.k]
            self.best[q], self.row[q] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)

    def _go(self, node: int, of: np.ndarray) -> None:
        if not len(of):
            return
        lo, hi, point, near, far = self.tree.nodes[node].tolist()
        if point < 0:
            self._leaf(self.tree.order[lo:hi], of)
            return
        mu = self.tree.mu[node]
        d = distances(self.queries[of], self.points[point])
        inside = d <= mu
        self._go(near, of[inside])
        self._go(far, of[~inside])
        for side, other in ((inside, far), (~inside, near)):
            open_ = side & (np.abs(d - mu) <= _reach(self.factor, self.best[of, -1]))
            self._go(other, of[open_])


def _reach(factor: float, tau: np.ndarray) -> np.ndarray:
    """How far may be pruned; the slack covers the rounding of distances, so that factor one is exact."""
    return factor * tau * (1 + 1e-12) + 1e-12


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _built(key: tuple, table: pa.Table) -> pa.Table:
    """The tree of one shard as bytes."""
    ids = table.column("ids").combine_chunks()
    # Points are numbered by their smallest id, so that ties by number are ties by id.
    table = table.take(pa.array(np.argsort(np.array([x[0].as_py() for x in ids]), kind="stable")))
    points, ids = _matrix(table.column("v")), table.column("ids").combine_chunks()
    tree = Tree(points)
    out = io.BytesIO()
    np.savez(out, points=points, order=tree.order, nodes=tree.nodes, mu=tree.mu, ids=ids.flatten().to_numpy(), many=ids.value_lengths().to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([out.getvalue()], pa.binary())})


def _search(trees: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    if not trees.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    held = np.load(io.BytesIO(trees.column("tree")[0].as_py()))
    tree = Tree.__new__(Tree)
    tree.order, tree.nodes, tree.mu = held["order"], held["nodes"], held["mu"]
    points, ids, many = held["points"], held["ids"], held["many"].astype(np.int64)
    start = np.cumsum(many) - many
    query_ids, asked = queries.column("query_id").to_numpy(), _matrix(queries.column("v"))
    found = Search(points, tree, asked, min(k + 1, len(points)), factor)
    q = np.repeat(np.arange(len(asked)), found.row.shape[1])
    p, d = found.row.ravel(), found.best.ravel()
    seen = np.isfinite(d)
    q, p, d = q[seen], p[seen], d[seen]
    size = many[p]
    at = np.arange(size.sum()) + np.repeat(start[p] - (np.cumsum(size) - size), size)
    q, d, vec = np.repeat(q, size), np.repeat(d, size), ids[at]
    other = vec != query_ids[q]
    q, d, vec = q[other], d[other], vec[other]
    order = np.lexsort((vec, d, q))
    q, d, vec = q[order], d[order], vec[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return pa.table({"query_id": query_ids[q[top]], "vec_id": vec[top], "score": d[top]})


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the number of the nearest centre and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, centres = _matrix(batch.column("v")), shared.value
            cell, away = np.zeros(len(v), np.int64), np.zeros(len(v))
            step = max(1, (1 << 22) // centres.size)
            for a in range(0, len(v), step):
                d = np.sqrt(((v[a : a + step, None] - centres[None]) ** 2).sum(-1))
                cell[a : a + step], away[a : a + step] = d.argmin(1), d.min(1)
            yield batch.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))

    schema = StructType(rows.schema.fields + [StructField("cell", LongType()), StructField("away", DoubleType())])
    return rows.mapInArrow(run, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest found of each query among all other rows: query_id, rank, vec_id, score."""
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), "v").where("vec_id IS NOT NULL")
    asked = usable(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("v")), "v").where("query_id IS NOT NULL")
    usual = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.where(F.size("v") == usual["width"]).groupBy("query_id").agg(F.min("v").alias("v"))

    # One point for equal vectors, with its smallest ids; the rank's limit works before the shuffle too.
    first = Window.partitionBy("v").orderBy("vec_id")
    small = rows.where(F.size("v") == usual["width"]).select("vec_id", "v").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    points = stored(small.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vptree-points")
    pivots = min(MOST_PIVOTS, -(-points.count() // shard_rows))
    centres = np.array([r["v"] for r in points.orderBy(F.xxhash64("v"), "v").select("v").limit(pivots).collect()])  # at most MOST_PIVOTS vectors
    celled = stored(_celled(points, centres), "vptree-cells")
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row for each centre
    parts = {r["cell"]: -(-r["n"] // shard_rows) for r in sizes}
    order = sorted(parts)
    before = np.concatenate([[0], np.cumsum([parts[c] for c in order])]).tolist()
    of_cell = rows.sparkSession.createDataFrame([(c, before[i], parts[c]) for i, c in enumerate(order)], "cell long, shard long, parts int")
    dealt = celled.join(F.broadcast(of_cell), "cell").select((F.col("shard") + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("shard"), "v", "ids")
    trees = stored(dealt.groupBy("shard").applyInArrow(_built, "shard long, tree binary"), "vptree-trees")

    def visit(pairs: DataFrame) -> DataFrame:
        """The k best of each query (query_id, v) in each shard that it is paired with."""
        pairs = stored(pairs, "vptree-visits")
        many = pairs.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        blocked = pairs.join(many, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        copies = trees.join(many, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def pair(trees: pa.Table, block: pa.Table) -> pa.Table:
            return _search(trees, block, k, factor)

        return copies.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block")).applyInArrow(pair, _FOUND)

    def shards(pairs: DataFrame) -> DataFrame:
        every = F.explode(F.sequence("shard", F.col("shard") + F.col("parts") - 1)).alias("shard")
        return pairs.join(F.broadcast(of_cell), "cell").select("query_id", "v", every)

    own = stored(_celled(asked, centres), "vptree-asked")
    near = stored(visit(shards(own)), "vptree-near")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    tau = near.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("tau"))
    wide = {r["cell"]: r["radius"] for r in sizes}
    shared = rows.sparkSession.sparkContext.broadcast((np.array(order), centres[order], np.array([wide[c] for c in order])))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Other cells that may hold something nearer."""
        for batch in batches:
            v, tau = _matrix(batch.column("v")), batch.column("tau").to_numpy(zero_copy_only=False).astype(float)
            reach, mine = _reach(factor, np.where(np.isnan(tau), np.inf, tau)), batch.column("cell").to_numpy()
            cell, middle, radius = shared.value
            step = max(1, (1 << 22) // middle.size)
            for a in range(0, len(v), step):
                d = np.sqrt(((v[a : a + step, None] - middle[None]) ** 2).sum(-1))
                q, c = np.nonzero((cell != mine[a : a + step, None]) & (d - radius <= reach[a : a + step, None]))
                yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id").take(pa.array(a + q)), "v": batch.column("v").take(pa.array(a + q)), "cell": cell[c]})

    rest = own.join(tau, "query_id", "left").select("query_id", "v", "cell", "tau")
    far = visit(shards(rest.mapInArrow(further, "query_id long, v array<double>, cell long")))
    return near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
