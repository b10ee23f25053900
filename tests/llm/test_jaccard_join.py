import random

import numpy as np
import pytest

from pyroclast.llm import jaccard_join
from pyroclast.llm.queries import op10_jaccard_join
from tests.llm.conftest import ODD, thue_morse, words

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(rows, width):
    out = []
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, width, percent):
    s = sets(rows, width)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= percent * (len(s[a][1]) + len(s[b][1]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(s):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(x), least[find(k)]) for k, (i, x) in enumerate(s))


def near_copies(seed, sizes):
    """Groups whose members differ by about as much as the threshold allows."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(7):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                at = rng.randrange(len(text))
                kind = rng.random()
                if kind < 0.4:
                    text[at] = f"x{rng.randint(0, 9)}"
                elif kind < 0.7:
                    del text[at]
                else:
                    text.insert(at, "y")
                if not text:
                    text = ["z"]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "percent", "sizes"), [(3, 90, [3, 8, 11, 12, 20, 21, 22, 23, 40, 90, 300]), (1, 90, list(range(1, 32))), (5, 80, [5, 9, 14, 19, 24, 50, 120, 400]), (1, 50, [4, 6, 9, 15, 30])])
def test_against_all_pairs(spark, width, percent, sizes):
    for seed in (1, 2):
        rows = near_copies(seed, sizes)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, jaccard_join.link(df, width, percent).collect())) == brute(rows, width, percent)


def test_blocks_of_a_long_list(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(60), rng.randint(0, 9)):
            text[at] = f"{i}-{at}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.link(df, 1, 90).collect())) == brute(rows, 1, 90)


def test_every_link_shares_a_key():
    """Linked sets meet on a list or in a subset, also where the ranges of a set are mostly empty."""
    rng = np.random.default_rng(3)
    plan = jaccard_join.plan_of(90)
    for size in [*range(1, 40), 60, 150, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, size, np.uint64))
            gone = plan.lost(len(a))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**64, rng.integers(0, gone + 1), np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 90 * (len(a) + len(b) - both):
                continue
            keys = []
            for x in (a, b):
                at = np.array([0, len(x)])
                keys.append(np.concatenate([f(plan, x, at)[1] for f in (jaccard_join._subset_keys, jaccard_join._list_keys)]))
            assert len(np.intersect1d(*keys))


def test_clustered_hashes_still_meet():
    plan = jaccard_join.plan_of(90)
    a = np.sort(np.concatenate([np.arange(1, 100, dtype=np.uint64), np.array([2**63], np.uint64)]))
    at = np.array([0, len(a)])
    b = np.sort(np.concatenate([a[5:], np.array([2**62 + 7, 2**62 + 9], np.uint64)]))
    one, two = (jaccard_join._list_keys(plan, x, np.array([0, len(x)]))[1] for x in (a, b))
    assert len(np.intersect1d(one, two)) and len(at)


def test_sketch_never_exceeds_the_differences():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1000, rng.integers(5, 300)).astype(np.uint64))
        b = np.unique(rng.integers(0, 1000, rng.integers(5, 300)).astype(np.uint64))
        s, t = (jaccard_join._sketches(x, np.array([0, len(x)]))[0] for x in (a, b))
        assert jaccard_join.differing(s, t) <= len(np.setxor1d(a, b))


def test_odd_rows(odd, empty, spark):
    assert sorted(map(tuple, jaccard_join.link(odd).collect())) == brute(ODD, 3, 90)
    assert jaccard_join.link(empty).count() == 0
    stay = jaccard_join.representatives(odd)
    assert stay.columns == odd.columns and {r.doc_id for r in stay.collect()} == {c for _, _, c in brute(ODD, 3, 90)}
    nulls = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard_join.link(nulls).collect() if r.n_shingles) == [(2, 5), (2, 5)]


def test_near_copies_with_null_and_repeated_ids(spark):
    base = [[f"{x}{k}" for k in range(60)] for x in "abcd"]

    def text(group, *at):
        return " ".join("other" + str(k) if k in at else w for k, w in enumerate(base[group]))

    rows = [
        (None, text(0)), (None, text(0, 1)), (None, text(0, 2)),  # no id at all
        (7, text(1)), (None, text(1, 1, 2, 3)), (8, text(1, 1, 2, 3, 4, 5)),  # 7 and 8 link through a null id
        (3, text(2)), (3, text(3)), (4, text(2, 9)), (2, text(3, 9)), (3, text(3, 8)), (3, text(2, 30)),  # one id, two groups
        (None, None), (None, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = lambda x: str(x)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.link(df, 1, 90).collect()), key=order)
    want = [(None, None)] * 3 + [(7, 7), (None, 7), (8, 7)] + [(3, 3), (3, 2), (4, 3), (2, 2), (3, 2), (3, 3)] + [(None, None)] * 2
    assert got == sorted(want, key=order)
    kept = jaccard_join.representatives(df, 1, 90).collect()
    assert sorted((str(r.doc_id), (r.text or "-")[0]) for r in kept) == [("2", "d"), ("3", "c"), ("7", "b"), ("None", "-"), ("None", "-"), ("None", "a")]
    twice = spark.createDataFrame([*rows[:3], *rows[:3]], "doc_id long, text string")
    assert jaccard_join.representatives(twice, 1, 90).count() == 1


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_jaccard_join(spark, FOLDER).collect())) == brute(rows, 3, 90)


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(2048)
    rows = [(1, one), (2, two), (3, f"a b {one}"), (4, f"a b {two}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.link(df).collect())) == brute(rows, 3, 90)


def test_hot_lists_are_counted_by_aggregates(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "ONE_IN", 1)
    rows = near_copies(3, [8, 20, 40, 90])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard_join.link(df).collect())) == brute(rows, 3, 90)
