from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pyroclast.operators import retrieval

NODES = [(1, "alpha beta gamma"), (2, "beta gamma delta"), (3, None), (4, ""), (5, "Alpha-Beta; beta alpha"), (6, "beta gamma beta gamma delta alpha beta")]


def test_published_postings_follow_changes(spark):
    nodes = spark.createDataFrame(NODES, "doc long, body string")
    asked = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "nothing of this"), (4, "beta gamma")], "qid long, text string")
    name = retrieval.publish_postings(nodes, "doc", "body", buckets=4)
    hits = lambda df: sorted(map(tuple, df.select("qid", "node", "matched", "wanted").collect()))
    now = nodes.where("doc <> 6").withColumn("body", F.when(F.col("doc") == 2, "gamma delta only").otherwise(F.col("body"))).union(spark.createDataFrame([(7, "gamma delta")], "doc long, body string"))
    for today in (nodes, now, nodes.where("false")):
        want = hits(retrieval.keyword_hits(retrieval.postings(today, "doc", "body"), asked))
        assert hits(retrieval.published_hits(name, today, "doc", "body", asked)) == want
    plan = retrieval.wanted_terms(asked).hint("merge").join(spark.table(name), "term")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # the terms', not the postings'


def test_terms_are_sent_or_joined(spark, monkeypatch):
    nodes, asked = spark.createDataFrame(NODES, "doc long, body string"), spark.createDataFrame([(1, "alpha beta gamma")], "qid long, text string")
    run = lambda: sorted(map(tuple, retrieval.keyword_hits(retrieval.postings(nodes, "doc", "body"), asked).collect()))
    sent = run()
    monkeypatch.setattr(retrieval, "SENT_TERMS", 1)
    assert run() == sent and len(sent) == 4


def test_vector_blocks_are_the_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, ("a", "b", None)[i % 3], [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(900, "a", None), (901, "a", [0.0] * 4), (902, "a", [1.0, 2.0]), (903, "b", [float("nan")] * 4), (904, "a", [1.0, None, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "node long, filter string, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(1, "a", rows[0][2]), (2, "b", rows[1][2]), (3, "c", rows[2][2]), (4, None, rows[2][2]), (5, "a", None), (6, "b", [0.0] * 4), (7, "a", [1.0, 1.0])], "qid long, filter string, vector array<double>")
    got = sorted(map(tuple, retrieval.vector_route(vectors, asked, 7).collect()))
    clean = vectors.where("node < 900 OR node = 901")
    monkeypatch.setattr(retrieval, "SENT_VECTORS", 0)
    want = sorted(map(tuple, retrieval.vector_route(clean, asked.where("qid < 7"), 7).collect()))
    assert [r for r in got if r[0] < 7] == want and [r for r in got if r[0] == 7] == [(7, "vector", 1, 902)]


def test_pair_counts(spark):
    texts = ["abab", None, "", "a", "日本🙂日本", "aba\nb", "é́é"]
    want = Counter(p for t in texts for p in {a + b for a, b in zip(t or "", (t or "")[1:], strict=False)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert {r.bigram: r.df for r in retrieval.pair_counts(df, "t").collect()} == want
    assert retrieval.pair_counts(df.where("false"), "t").count() == 0
