import random
import time
from collections import Counter

import numpy as np
import pytest

from pyroclast.llm import substring_dedup, suffix_dedup
from pyroclast.llm.queries import op5_suffix_dedup, op6_substring_dedup
from pyroclast.llm.repeats import SHARD, Shape
from tests.llm.conftest import ODD, sha, thue_morse, words

FOLDER = "/root/testdata/sf0.001"


def removed(units, width):
    count = Counter(tuple(u[k : k + width]) for u in units for k in range(len(u) - width + 1))
    out = []
    for u in units:
        depth = np.zeros(len(u) + 1, int)
        for k in range(len(u) - width + 1):
            if count[tuple(u[k : k + width])] > 1:
                depth[k] += 1
                depth[k + width] -= 1
        out.append(np.cumsum(depth[:-1]) > 0)
    return out


def brute_words(rows, width):
    units = [words(t) for _, t, *_ in rows]
    return sorted((r[0], len(u), int(g.sum()), sha(" ".join(x for x, y in zip(u, g, strict=True) if not y))) for r, u, g in zip(rows, units, removed(units, width), strict=True))


def brute_bytes(rows, width):
    units = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for r, u, g in zip(rows, units, removed(units, width), strict=True):
        first = g.copy()
        first[1:] &= ~g[:-1]
        out.append((r[0], len(u), int(g.sum()), int(first.sum()), sha(bytes(x for x, y in zip(u, g, strict=True) if not y))))
    return sorted(out)


def corpus(seed, n=60):
    """Few words, shared passages in different surroundings, periodic stretches, copies."""
    rng = random.Random(seed)
    vocabulary = ["ab", "cd", "e", "fgh", "ij"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                text += p[a : a + rng.randint(1, len(p))]
            elif kind < 0.6:
                text += [rng.choice(vocabulary)] * rng.randint(1, 60)
            else:
                text += [rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(text)))
    return rows + [(n, rows[3][1]), (n + 1, None), (n + 2, "")]


@pytest.mark.parametrize(("seed", "width", "shard"), [(1, 12, SHARD), (2, 35, SHARD), (3, 12, 2), (4, 5, 1)])
def test_words(spark, seed, width, shard):
    rows = corpus(seed)
    got = substring_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, shard=shard)
    assert sorted(map(tuple, got.collect())) == brute_words(rows, width)


@pytest.mark.parametrize(("seed", "width", "shard"), [(1, 40, SHARD), (2, 200, SHARD), (3, 40, 2), (4, 23, 1)])
def test_bytes(spark, seed, width, shard):
    rows = corpus(seed)
    got = suffix_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, shard=shard)
    assert sorted(map(tuple, got.collect())) == brute_bytes(rows, width)


@pytest.mark.parametrize("solve", [suffix_dedup.refine, substring_dedup.match])
def test_solvers_alone(solve):
    rng = np.random.default_rng(7)
    for width in (9, 20, 33):
        parts = [rng.integers(1, 3, rng.integers(width, width + 9)) for _ in range(12)]
        parts += [parts[0][1:], np.ones(width + 5, int)]
        parts = [p for p in parts if len(p) >= width]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        data = np.concatenate(parts).astype(np.uint8 if solve is suffix_dedup.refine else np.uint64)
        count = Counter(tuple(p[k : k + width]) for p in parts for k in range(len(p) - width + 1))
        want = [count[tuple(p[k : k + width])] > 1 for p in parts for k in range(len(p) - width + 1)]
        assert solve(data, at, Shape(width, 3, 4)).tolist() == want


def test_odd_rows(odd, empty):
    assert sorted(map(tuple, substring_dedup.summary(odd).collect())) == brute_words(ODD, 35)
    assert sorted(map(tuple, suffix_dedup.summary(odd).collect())) == brute_bytes(ODD, 200)
    assert substring_dedup.summary(empty).count() == 0 and suffix_dedup.summary(empty).count() == 0


def test_texts(spark):
    rows = [(1, "x y " * 4 + "é"), (2, "é" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.deduplicate(df, 3).collect()} == {1: "é", 2: "é" * 30}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(df, 9).collect()}[2] == 60


def test_queries_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_substring_dedup(spark, FOLDER).collect())) == brute_words(rows, 35)
    assert sorted(map(tuple, op5_suffix_dedup(spark, FOLDER).collect())) == brute_bytes(rows, 200)


def test_texts_that_polynomials_confuse(spark):
    one, two = thue_morse(2048)
    around = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*around[:20], w, *around[21:]])) for i, w in enumerate((one, two))] + [(2, one), (3, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.summary(df, 35).collect())) == brute_words(rows, 35)
    assert sorted(map(tuple, suffix_dedup.summary(df, 200).collect())) == brute_bytes(rows, 200)


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    """Rows that repeat id and text, and texts that are hashed in segments."""
    from pyroclast.llm import repeats

    rows = [*corpus(6, 30)] * 2 + [(77, " ".join(f"v{k % 700}" for k in range(2000))), (None, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    monkeypatch.setattr(repeats, "STRETCH", 128)
    order = lambda x: str(x)
    assert sorted(map(tuple, substring_dedup.summary(df, 12, shard=8).collect()), key=order) == sorted(brute_words_of(rows, 12), key=order)


def brute_words_of(rows, width):
    units = [words(t) for _, t in rows]
    return [(r[0], len(u), int(g.sum()), sha(" ".join(x for x, y in zip(u, g, strict=True) if not y))) for r, u, g in zip(rows, units, removed(units, width), strict=True)]


def test_segments_cover_every_window_once(monkeypatch):
    import pyarrow as pa

    from pyroclast.llm import repeats
    from pyroclast.llm.arrays import flat

    texts = ["".join(random.Random(k).choice("abc") for _ in range(n)) for k, n in enumerate((400, 3, 0, 90, 250))]
    batch = pa.record_batch({"key": pa.array(range(5), pa.int64()), "text": pa.array(texts)})
    method, shape = repeats.Method(flat, suffix_dedup.values(4), 3, suffix_dedup.refine, np.dtype(np.uint8)), Shape(12, 4, 2)
    rows = {}
    for segment in (1 << 20, 50):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        out = pa.Table.from_batches(list(repeats._span_rows(method, shape)([batch]))).to_pylist()
        windows = sorted((r["key"], r["at"] + k) for r in out for k in range(r["windows"]))
        assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 11)]
        rows[segment] = {(r["key"], r["at"] + k): (r["gram"], r["at"] + r["anchor"]) for r in out for k in range(r["windows"])}
    assert rows[50] == rows[1 << 20]


def test_buckets():
    rng = np.random.default_rng(5)
    for keys, bits in ((rng.integers(0, 50, 300), 6), (rng.integers(-(1 << 63), 1 << 63, 300) // (1 << 57), 64), (np.zeros(0, np.int64), 3), (np.array([4]), 62)):
        assert suffix_dedup._buckets(keys, bits).tolist() == np.unique(keys, return_inverse=True)[1].tolist()


def test_refining_costs_a_few_sorts():
    """Pairs of equal texts keep every suffix in company to the end; five rounds take less than three sorts by two keys."""
    rng = np.random.default_rng(6)
    texts = rng.integers(97, 123, (130, 2000)).astype(np.uint8)
    data, at = np.repeat(texts, 2, axis=0).ravel(), np.arange(0, 260 * 2000 + 1, 2000)
    keys = rng.integers(0, len(data), (2, len(data)))

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert suffix_dedup.refine(data, at, Shape(200, 32, 43)).all()
    assert least(lambda: suffix_dedup.refine(data, at, Shape(200, 32, 43))) < 3 * least(lambda: np.lexsort(keys))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 169])
def test_least_key_of_each_window(width, monkeypatch):
    from pyroclast.llm import repeats

    keys = np.random.default_rng(width).integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(keys[i : i + width])) for i in range(501 - width)]
    assert repeats.leftmost_least(keys, width).tolist() == want
    monkeypatch.setattr(repeats, "_SEGMENT", 64)
    assert repeats.leftmost_least(keys, width).tolist() == want
    assert repeats.leftmost_least(keys[: width - 1], width).tolist() == []


def test_hashes_of_all_slices():
    from pyroclast.llm.arrays import prefix_hash, slice_hash, slice_hashes

    sums = prefix_hash(np.random.default_rng(2).integers(0, 1 << 60, 100).astype(np.uint64))
    for width in (1, 25, 100, 101, 150):
        starts = np.arange(max(0, 101 - width))
        assert slice_hashes(sums, width).tolist() == slice_hash(sums, starts, starts + width).tolist()
