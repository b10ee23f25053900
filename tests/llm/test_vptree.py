import numpy as np
import pytest

from pyroclast.llm import vptree
from pyroclast.llm.queries import op3_nearest_vectors


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, x) for r, (x, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_exact_with_ties(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3) + 1]) for i in range(300)] + [(300 + i, [2.0, 2.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.search(df, df.where("vec_id % 20 = 0"), 10, 1.0, shard_rows=shard_rows, block_rows=7)
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert sorted(map(tuple, got.collect())) == want


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in op3_nearest_vectors(spark, "/root/testdata/sf0.001").collect()}
    want = {x[:1] + x[2:3] for x in brute(rows, [r for r in rows if r[0] % 100 == 0], 10)}
    assert len(got & want) / len(want) >= 0.9


def test_relaxed_pruning_visits_less(spark):
    points = np.random.default_rng(2).random((4000, 6))
    tree = vptree.Tree(points)
    exact, loose = (vptree.Search(points, tree, points[:50], 5, f) for f in (1.0, 0.3))
    assert loose.visited < exact.visited
    hit = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.row, loose.row, strict=True)])
    assert hit > 0.5


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.5]), (6, [1.0, 2.5]), (7, [1.0]), (8, []), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int")
    got = [tuple(r) for r in vptree.search(df, df, 10).orderBy("query_id").collect()]
    assert got == [(0, 1, 6, 0.5), (6, 1, 0, 0.5)]
    assert vptree.search(df.where("false"), df.where("false")).count() == 0


def test_cells_far_away_are_not_visited(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(100 * (i % 6), 0.1, 4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 = 0")
    assert sorted(map(tuple, vptree.search(df, queries, 5, shard_rows=30, block_rows=3).collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_repeated_ids(spark):
    rows = [(1, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (3, [9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vptree.search(df, df.where("vec_id = 1"), 10).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 8.0)]
