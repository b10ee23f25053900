"""Retrieval: ranked routes, reciprocal-rank fusion, and what is built around them (§2.10).

Many questions are answered by one job: routes are DataFrames of (qid, route,
rank, node), joined on terms or filters, never as a product of questions and
nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.functions.text import bigrams, word_pairs
from pyroclast.sources.shared import fresh

# The constant of reciprocal-rank fusion and the routes' weights.
RRF_K = 60
ROUTE_WEIGHT = {"keyword": 0.5, "keyword_last": 0.5, "occupancy": 2.0, "legend": 2.0, "vector": 0.25, "table": 2.0}
#: Order of routes where scores tie.
ROUTE_ORDER = ["keyword", "keyword_last", "occupancy", "legend", "table", "vector"]
PINNED_BONUS, PINNED_STEP = 10.0, 0.01
#: Up to so many terms of questions are sent to where the postings are, and so many questions' vectors to where the vectors are.
SENT_TERMS, SENT_VECTORS = 500_000, 4096


def postings(nodes: DataFrame, node: str, text: str) -> DataFrame:
    """One row per node and distinct pair of words."""
    return nodes.select(F.col(node).alias("node"), F.explode(word_pairs(F.col(text))).alias("term"))


def keyword_route(index: DataFrame, questions: DataFrame, k: int = 20, route: str = "keyword", at_least: float = 0.0) -> DataFrame:
    """Nodes by how many of a question's terms they have, then by id.

    ``questions`` has qid and text; ``at_least`` is the share of terms a node must have.
    """
    return best_hits(keyword_hits(index, questions), k, route, at_least)


def keyword_hits(index: DataFrame, questions: DataFrame) -> DataFrame:
    """How many of the terms that a question wants each node has; several routes may rank them.

    Terms of few questions (they are counted) go to the postings, so that pairs that nobody asks for are dropped where they are made.
    """
    terms = wanted_terms(questions)
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    return _matched((F.broadcast(terms) if few else terms).join(index, "term"))


def wanted_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", word_pairs(F.col("text")).alias("terms")).select("qid", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))


def _matched(met: DataFrame) -> DataFrame:
    return met.groupBy("qid", "node").agg(F.count("*").alias("matched"), F.first("wanted").alias("wanted"))


def publish_postings(nodes: DataFrame, node: str, text: str, buckets: int = 64) -> str:
    """Write the postings of ``nodes`` (one row a node) once and return the version's name.

    They are a table bucketed and sorted by term, so questions' terms meet them without moving them; beside it stands
    what each node's text was, to tell later what has changed.  A version is never written to again: the
    next one gets its own name, and whoever publishes it hands the name on.
    """
    spark, name = nodes.sparkSession, f"postings_{uuid.uuid4().hex}"
    rows = postings(nodes, node, text).repartition(buckets, "term")
    rows.write.bucketBy(buckets, "term").sortBy("term", "node").option("path", fresh(spark, name)).saveAsTable(name)
    nodes.select(F.col(node).alias("node"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash")).write.option("path", fresh(spark, name + "_nodes")).saveAsTable(name + "_nodes")
    return name


def published_hits(name: str, nodes: DataFrame, node: str, text: str, questions: DataFrame) -> DataFrame:
    """``keyword_hits`` of today's nodes: from the published postings, and from the texts only of nodes that came or changed since.

    Nodes that went or changed are left out of what was published.
    """
    spark = nodes.sparkSession
    now = nodes.select(F.col(node).alias("node"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    then = spark.table(name + "_nodes")
    fresh_nodes = now.join(then, ["node", "hash"], "left_anti")
    stale = then.join(now.select("node", "hash"), ["node", "hash"], "left_anti").select("node")
    terms = wanted_terms(questions)
    old = _matched(spark.table(name).join(terms, "term")).join(stale, "node", "left_anti")
    return old.unionByName(keyword_hits(postings(fresh_nodes, "node", "text"), questions))


def best_hits(hits: DataFrame, k: int = 20, route: str = "keyword", at_least: float = 0.0) -> DataFrame:
    return ranked(hits.where(F.col("matched") >= F.col("wanted") * at_least), route, k, F.desc("matched"), F.col("node"))


def ranked(hits: DataFrame, route: str, k: int, *order: Column) -> DataFrame:
    """The k first nodes of each question, ranks from 1."""
    w = Window.partitionBy("qid").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", F.lit(route).alias("route"), "rank", "node")


def dot(x: Column, y: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one has no length."""
    return _cosine(a, b, F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))


def _cosine(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    norm = length_a * length_b
    return F.when(norm > 0, dot(a, b) / norm)


def vector_route(vectors: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Nodes by cosine (to twelve places) among those that share the question's filter.

    ``vectors`` has node, filter and vector; ``questions`` qid, filter and vector.  Up to ``SENT_VECTORS`` questions go to
    the vectors as matrices, one for each filter: a batch of vectors is one product, and hands on its ``k`` best for each question.
    More questions meet the vectors in a join on the filter.  Nulls, vectors of no length and of other dimensions take no part.
    """
    asked = questions.where("filter IS NOT NULL AND vector IS NOT NULL").select("qid", "filter", F.col("vector").cast("array<double>").alias("q"))
    if asked.limit(SENT_VECTORS + 1).count() > SENT_VECTORS:
        length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
        pairs = asked.withColumn("q_length", length("q")).join(vectors.select("node", "filter", "vector", length("vector").alias("length")), "filter")
        score = F.round(_cosine(F.col("q"), F.col("vector"), F.col("q_length"), F.col("length")), 12)
        return ranked(pairs.select("qid", "node", score.alias("score")).where("score IS NOT NULL"), "vector", k, F.desc("score"), F.col("node"))
    groups: dict = {}
    for r in asked.collect():  # at most SENT_VECTORS rows, as counted
        q = np.array(r.q, float)
        if np.isfinite(q).all() and q.any():
            groups.setdefault((r["filter"], len(q)), []).append((r.qid, q / np.sqrt(q @ q)))
    shared = vectors.sparkSession.sparkContext.broadcast({key: (np.array([qid for qid, _ in rows]), np.stack([q for _, q in rows])) for key, rows in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            filters, nodes = np.array(batch.column("filter").to_pylist(), object), batch.column("node").to_numpy(zero_copy_only=False)
            for (filter_, dimensions), (qids, matrix) in shared.value.items():
                at = np.flatnonzero((filters == filter_) & (size == dimensions))
                if not len(at):
                    continue
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dimensions)
                length = np.sqrt((values * values).sum(1))
                ok = np.isfinite(length) & (length > 0)
                if not ok.any():
                    continue
                score = np.round((values[ok] / length[ok, None]) @ matrix.T, 12)
                some = nodes[at[ok]]
                best = np.lexsort((np.broadcast_to(some[:, None], score.shape), -score), axis=0)[:k]
                yield pa.RecordBatch.from_pydict({"qid": np.broadcast_to(qids, best.shape).ravel(), "node": some[best].ravel(), "score": np.take_along_axis(score, best, 0).ravel()})

    kinds = dict(questions.dtypes) | dict(vectors.dtypes)
    near = vectors.where("filter IS NOT NULL AND vector IS NOT NULL").select("node", "filter", F.col("vector").cast("array<double>").alias("vector"))
    return ranked(near.mapInArrow(run, f"qid {kinds['qid']}, node {kinds['node']}, score double"), "vector", k, F.desc("score"), F.col("node"))


def pair_counts(texts: DataFrame, text: str) -> DataFrame:
    """bigram and df: in how many texts each pair of neighbouring characters occurs.

    Pairs are numbers of two code points; each batch hands on one row for each pair that it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[np.ndarray] = []
            for t in batch.column("text").to_pylist():
                points = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                pairs.append(np.unique(points[:-1] << 32 | points[1:]))
            found, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_pydict({"bigram": pa.array([chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in found.tolist()], pa.string()), "n": pa.array(n, pa.int64())})

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("df"))


def known_pairs(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``texts`` with an array ``hits``: for each bigram of the text whether ``known`` (bigram) has it.

    The vocabulary may be of any size: bigrams meet it in a join, each distinct text once.
    """
    distinct = texts.select(text).distinct()
    places = distinct.select(text, F.posexplode(bigrams(F.col(text))).alias("i", "bigram"))
    met = places.join(known.select("bigram").distinct(), "bigram", "left_semi").groupBy(text).agg(F.collect_set("i").alias("at"))
    none = F.array().cast("array<int>")
    hits = F.transform(bigrams(F.col(text)), lambda _, i: F.array_contains(F.coalesce("at", none), i.cast("int")))
    return texts.join(met, text, "left").withColumn("hits", hits).drop("at")


def fuse(routes: list[DataFrame], pinned: DataFrame | None = None, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """qid, rank, node, score and routes of the k best nodes by reciprocal-rank fusion.

    A route without rows changes nothing.  ``pinned`` (qid, ord, node; ord from 0)
    adds its bonus and puts the route ``direct`` first.  Ties go to the earlier
    route, then to the better rank.
    """
    weight = ROUTE_WEIGHT | (weights or {})
    table = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    order = F.create_map(*[F.lit(x) for i, r in enumerate(ROUTE_ORDER) for x in (r, i)])
    rows = reduce(DataFrame.unionByName, routes).select("qid", "node", "route", (table[F.col("route")] / (RRF_K + F.col("rank"))).alias("part"), order[F.col("route")].alias("ord"), "rank")
    if pinned is not None:
        bonus = pinned.select("qid", "node", F.lit("direct").alias("route"), (PINNED_BONUS - PINNED_STEP * F.col("ord")).alias("part"), F.lit(-1).alias("ord"), (F.col("ord") + 1).alias("rank"))
        rows = rows.unionByName(bonus)
    first = F.min(F.struct(F.when(F.col("ord") < 0, len(ROUTE_ORDER)).otherwise(F.col("ord")), F.col("rank"))).alias("first")
    names = F.transform(F.array_sort(F.collect_set(F.struct("ord", "route"))), lambda x: x["route"]).alias("routes")
    hits = rows.groupBy("qid", "node").agg(F.round(F.sum("part"), 9).alias("score"), first, names)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "node")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "node", "score", "routes")


def quality(answers: DataFrame, expected: DataFrame, k: int = 3, kind: str | None = None) -> DataFrame:
    """hit@k, top-1 and mean reciprocal rank over all expected questions; misses count 0.

    ``answers``: qid, rank, node.  ``expected``: qid, node and perhaps a column ``kind``.
    """
    found = expected.select("qid", "node").join(answers, ["qid", "node"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    asked = expected.select("qid", *([kind] if kind else [])).distinct().join(found, "qid", "left")
    return asked.groupBy(*([kind] if kind else [])).agg(
        F.count("*").alias("questions"), F.count_if(F.col("rank") <= k).alias("hits"), F.count_if(F.col("rank") == 1).alias("top1"), F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*"), 6).alias("mrr")
    )


def verify_answers(answers: DataFrame) -> DataFrame:
    """Citations outside 1..sources, and articles mentioned that no source has.

    Columns: id, cited (array of int), sources (int), mentioned and allowed (arrays of strings).
    """
    bad = F.filter("cited", lambda n: (n < 1) | (n > F.col("sources")))
    return answers.select("id", F.array_except("cited", bad).alias("valid"), bad.alias("invalid"), F.array_sort(F.array_except("mentioned", "allowed")).alias("unverified"))


def focused_rows(rows: Column, labels: Column, question: Column, limit: int, shortest: int = 4) -> Column:
    """All rows if they are short enough, else those whose label the question has; all if none."""
    whole = F.array_join(rows, "\n")
    hit = F.filter(F.zip_with(rows, labels, lambda r, l: F.struct(r.alias("r"), ((F.length(l) >= shortest) & F.contains(question, l)).alias("k"))), lambda x: x["k"])
    some = F.concat(F.array_join(F.transform(hit, lambda x: x["r"]), "\n"), F.lit("\n… "), (F.size(rows) - F.size(hit)).cast("string"))
    return F.when((F.length(whole) <= limit) | (F.size(hit) == 0), whole).otherwise(some)
