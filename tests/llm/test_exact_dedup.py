from pyspark.sql import functions as F

from pyroclast.llm import exact_dedup
from tests.llm.conftest import ODD, sha


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    out = []
    for i, t, *_ in rows:
        group = [(len(x or ""), -j, j) for j, x, *_ in rows if norm(x) == norm(t)]
        keep = max(group)[2]
        out.append((i, keep, len(group), i == keep, sha(norm(t))))
    return sorted(out)


def test_odd_rows(odd):
    assert sorted(map(tuple, exact_dedup.assign(odd).collect())) == brute(ODD)


def test_equal_digests_stay_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "c", "abc", "a", "ca", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.assign(df, digest=lambda t: F.length(t) % 2)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_stay(odd, empty, spark):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, *_ in brute(ODD)})
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    same_id = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(r.text for r in exact_dedup.deduplicate(same_id).collect()) == ["a", "b", "c"]
