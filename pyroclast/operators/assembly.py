"""What is put together from routes, trees and drawings: filtered routes, answer sources, codes, nested blocks, layout roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.operators import retrieval

# Sources of an answer, hits that bring in a whole article, articles brought in at most, depth of nested blocks.
ASK_SOURCES, ARTICLE_HITS, ARTICLES, BLOCK_DEPTH = 8, 3, 2, 6


def expand_synonyms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, term) with all terms of the same synonym group (H39). ``groups``: grp, term."""
    other = groups.join(groups.withColumnRenamed("term", "other"), "grp").select("term", "other").distinct()
    return terms.unionByName(terms.join(other, "term").select("qid", F.col("other").alias("term"))).distinct()


def filtered_route(index: DataFrame, nodes: DataFrame, questions: DataFrame, route: str, k: int = 10) -> DataFrame:
    """Keyword route among nodes that share a code with the question; questions without codes or topic have none.

    ``nodes``: node, codes; ``questions``: qid, text, codes.
    """
    asked = questions.where((F.size("codes") > 0) & (F.trim("text") != ""))
    allowed = asked.select("qid", F.explode("codes").alias("code")).join(nodes.select("node", F.explode("codes").alias("code")), "code").select("qid", "node").distinct()
    hits = retrieval.keyword_route(index, asked.select("qid", "text"), 1 << 30, route).withColumnRenamed("rank", "all_rank").join(allowed, ["qid", "node"])
    return retrieval.ranked(hits, route, k, F.col("all_rank"))


def ask_sources(answers: DataFrame, articles: DataFrame) -> DataFrame:
    """The first sources of each question, and whole articles that are hit often.

    ``answers``: qid, rank, node; ``articles``: node, article.
    """
    top = answers.where(F.col("rank") <= ASK_SOURCES).select("qid", "rank", "node", F.lit("hit").alias("kind"))
    counts = answers.join(articles, "node").groupBy("qid", "article").agg(F.count("*").alias("hits"), F.min("rank").alias("first")).where(F.col("hits") >= ARTICLE_HITS)
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), "first")
    more = counts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ARTICLES)
    return top.unionByName(more.select("qid", (F.col("n") + ASK_SOURCES).alias("rank"), F.col("article").alias("node"), F.lit("article").alias("kind")))


def derive_codes(items: DataFrame, points: DataFrame) -> DataFrame:
    """Codes class-number of the points under each class item, numbered in order (I04). ``items``: item, cls; ``points``: item, seq, text."""
    w = Window.partitionBy("item").orderBy("seq")
    return points.withColumn("number", F.row_number().over(w)).join(items, "item").select(F.concat_ws("-", "cls", "number").alias("code"), "cls", "number", "text")


def explode_blocks(inserts: DataFrame, blocks: DataFrame, depth: int = BLOCK_DEPTH) -> DataFrame:
    """Primitives of nested inserts in drawing coordinates.

    ``inserts``: id, name, x, y, layer.  ``blocks``: name, child (a block's name, or
    null for a primitive), dx, dy, layer; layer 0 takes the insert's layer.  One
    equi-join a level, ``depth`` at most, so a block within itself ends.
    """
    level, out = inserts.select("id", "name", "x", "y", "layer"), None
    parts = blocks.select("name", "child", "dx", "dy", F.col("layer").alias("own"))
    for _ in range(depth):
        met = level.join(parts, "name").select("id", "child", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.when(F.col("own") == "0", F.col("layer")).otherwise(F.col("own")).alias("layer"))
        found = met.where("child IS NULL").select("id", "x", "y", "layer")
        out = found if out is None else out.unionByName(found)
        level = met.where("child IS NOT NULL").select("id", F.col("child").alias("name"), "x", "y", "layer")
    return out


def layout_roles(layouts: DataFrame, same: float = 0.8) -> DataFrame:
    """main, detail or duplicate for each layout of a file.

    ``layouts``: file, ord, named (whether the name ends in a number in brackets), x0, y0, x1, y1.
    In order of (named, ord): a layout that overlaps a main one by ``same`` is its
    duplicate, one inside a main one or with such a name a detail, others are main.
    """

    def roles(pdf: pd.DataFrame) -> pd.DataFrame:
        mains, out = [], []
        for r in pdf.sort_values(["named", "ord"]).itertuples():
            role = "main"
            for m in mains:
                w, h = min(r.x1, m.x1) - max(r.x0, m.x0), min(r.y1, m.y1) - max(r.y0, m.y0)
                both = max(w, 0) * max(h, 0)
                whole = (r.x1 - r.x0) * (r.y1 - r.y0) + (m.x1 - m.x0) * (m.y1 - m.y0) - both
                inside = r.x0 >= m.x0 and r.y0 >= m.y0 and r.x1 <= m.x1 and r.y1 <= m.y1
                if whole > 0 and both / whole >= same:
                    role = "duplicate"
                    break
                if inside:
                    role = "detail"
            if role == "main" and r.named:
                role = "detail"
            if role == "main":
                mains.append(r)
            out.append((r.file, r.ord, role))
        return pd.DataFrame(out, columns=["file", "ord", "role"])

    kinds = dict(layouts.dtypes)
    return layouts.groupBy("file").applyInPandas(roles, f"file {kinds['file']}, ord {kinds['ord']}, role string")


def reading_order(texts: DataFrame, group: str) -> DataFrame:
    """Texts of each group from top to bottom, then from left to right."""
    rows = texts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("a"), F.col("x").alias("b"), F.col("text").alias("c")))).alias("x"))
    return rows.select(group, F.array_join(F.transform("x", lambda s: s["c"]), " ").alias("title"))
