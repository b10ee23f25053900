import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyroclast.llm import importance
from pyroclast.llm.queries import ORACLES, QUERIES
from tests.oracle import FOLDER, connect, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plainly(docs, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    """Every row's values by Python's own means: (id, n_features, weight, score, rank)."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in runs(x, n)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        words, found = runs(x, n)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least])
    order = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0]))
    rank = {k: r for r, k in enumerate(order[: percent * len(order) // 100], 1)}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(out)]


def key(r):
    return [(x is None, x or 0) for x in r]


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=key)


@pytest.mark.parametrize("n, buckets, percent, least", [(2, 10_000, 25, 20), (1, 7, 100, 0), (4, 300, 37, 3)])
def test_same_as_plain_python(spark, n, buckets, percent, least):
    rng = np.random.default_rng(n)
    words = ["The", "cat", "Ärger", "日本", "x1", "é", "Z", "and", "aA", "🙂"]
    texts = [" -\n.\x00"[int(rng.integers(5))].join(rng.choice(words, rng.integers(0, 60))) for _ in range(120)]
    docs = [*enumerate(texts), (500, None), (501, ""), (502, " .\n"), (None, texts[3]), *[(600 + k, "copy of the same words " * 9) for k in range(200)]]
    target = [*texts[:4], None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    found = importance.resample(df, aim, n=n, buckets=buckets, percent=percent, least_words=least)
    assert got(found) == sorted(plainly(docs, target, n, buckets, percent, least), key=key)


def test_segments_and_packing():
    rng = np.random.default_rng(4)
    text = bytes(rng.choice(list("abC é. zZ9-".encode()), 5000)) + b" " + b"w" * 700
    whole = importance.scan(text, 3, 1000)
    for size in (1, 7, 64, 333, 10_000):
        part = importance.scan(text, 3, 1000, size)
        assert part[0] == whole[0] and (part[1] == whole[1]).all()
    for numbers in ([], [0], [0, 0, 0], [255], [254, 255, 256, 510, 511], [9999, 0, 9999], rng.integers(0, 100_000, 300)):
        x = np.array(numbers, np.int64)
        assert (importance.unpacked(np.frombuffer(importance.packed(x), np.uint8)) == np.sort(x)).all()
    assert len(importance.packed(rng.integers(0, 10_000, 1000))) < 1100


def test_repeated_rows_are_ranked_one_by_one(spark):
    df = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("same words " * 12).alias("text")).repartition(7)
    ranks = sorted(r["rank"] or 0 for r in importance.resample(df, df.limit(1)).collect())
    assert ranks == [0] * 2250 + list(range(1, 751))


def test_odd_rows(spark, odd, empty):
    found = importance.resample(odd.withColumn("rank", F.lit("a")).withColumn("at", F.lit("b")), odd)
    assert got(found) == sorted(plainly([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in odd.collect()]), key=key)
    assert got(importance.resample(odd, empty)) == sorted(plainly([(r.doc_id, r.text) for r in odd.collect()], []), key=key)
    assert importance.resample(empty, odd).count() == importance.resample(empty, empty).count() == 0
    with pytest.raises(ValueError):
        importance.resample(odd, odd, n=0)


def test_query(spark):
    found = QUERIES["op11_importance_resampling"](spark, FOLDER).toPandas()
    assert rows(found) == rows(connect().execute(ORACLES["op11_importance_resampling"]).df())
