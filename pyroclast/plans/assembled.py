"""Queries of filtered routes, answer sources, codes, nested blocks and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.operators import assembly, retrieval
from pyroclast.plans.knowledge import _KEYWORD, keyword_route
from pyroclast.plans.registry import query, table


@query(_KEYWORD + """
    , k AS (SELECT h.qid, h.node, row_number() OVER (PARTITION BY h.qid ORDER BY matched DESC, h.node) AS r FROM hits h JOIN documents d ON d.doc_id = h.node WHERE d.lang = CASE WHEN h.qid % 2 = 0 THEN 'en' ELSE 'fr' END)
    SELECT qid, 'occupancy' AS route, r::INTEGER AS rank, node FROM k WHERE r <= 10
""")
def occupancy_route(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword route among nodes that share a code with the question."""
    docs = table(spark, sf, "documents")
    nodes = docs.where("lang IS NOT NULL").select(F.col("doc_id").alias("node"), F.array("lang").alias("codes"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.array(F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr")).alias("codes"))
    return assembly.filtered_route(retrieval.postings(docs, "doc_id", "text"), nodes, asked, "occupancy")


@query(_KEYWORD + """
    , k AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits),
    a AS (SELECT qid, node // 10 AS article, count(*) AS hits, min(rank) AS first FROM k WHERE rank <= 20 GROUP BY 1, 2 HAVING count(*) >= 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, first) AS n FROM a)
    SELECT qid, rank::INTEGER AS rank, node, 'hit' AS kind FROM k WHERE rank <= 8 UNION ALL SELECT qid, (n + 8)::INTEGER, article, 'article' FROM n WHERE n <= 2
""")
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight sources, and whole articles that are hit three times."""
    articles = table(spark, sf, "documents").select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 10).alias("article"))
    return assembly.ask_sources(keyword_route(spark, sf), articles)


@query("""
    SELECT r_name || '-' || row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS code, r_name AS cls, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INTEGER AS number, n_name AS text
    FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def derived_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of the points under each class."""
    items = table(spark, sf, "region").select(F.col("r_regionkey").alias("item"), F.col("r_name").alias("cls"))
    points = table(spark, sf, "nation").select(F.col("n_regionkey").alias("item"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("text"))
    return assembly.derive_codes(items, points)


@query("""
    SELECT c_custkey AS id, x, y, layer FROM (
        SELECT c_custkey, unnest([c_custkey + 1.0, c_custkey + 12.0, c_custkey + 22.0]) AS x, unnest([0.0, 2.0, 2.0]) AS y, unnest([c_mktsegment, 'W', 'W']) AS layer FROM customer)
""")
def nested_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Primitives of blocks inside blocks; layer 0 takes the insert's layer."""
    rows = [("A", None, 1.0, 0.0, "0"), ("A", "B", 10.0, 0.0, "0"), ("A", "B", 20.0, 0.0, "0"), ("B", None, 2.0, 2.0, "W")]
    blocks = spark.createDataFrame(rows, "name string, child string, dx double, dy double, layer string")
    inserts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("A").alias("name"), F.col("c_custkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("c_mktsegment").alias("layer"))
    return assembly.explode_blocks(inserts, blocks)


@query("""
    SELECT p_brand AS file, p_partkey AS ord, CASE WHEN first THEN 'main' WHEN p_partkey % 2 = 0 THEN 'duplicate' ELSE 'detail' END AS role FROM (SELECT *, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part)
""")
def layout_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts that repeat or lie inside an earlier one."""
    p = table(spark, sf, "part")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    small = (F.col("p_partkey") != F.col("first")) & (F.col("p_partkey") % 2 == 1)
    rows = p.join(first, "p_brand").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.lit(False).alias("named"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(small, 5.0).otherwise(10.0).alias("x1"), F.when(small, 5.0).otherwise(10.0).alias("y1"))
    return assembly.layout_roles(rows)


@query("SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY -(n_nationkey % 3), n_nationkey) AS title FROM nation GROUP BY 1")
def titles_in_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """texts from top to bottom, then from left to right."""
    n = table(spark, sf, "nation").select("n_regionkey", (F.col("n_nationkey") % 3).cast("double").alias("y"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_name").alias("text"))
    return assembly.reading_order(n, "n_regionkey")


@query("""
    SELECT o_orderkey AS qid, unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['1-URGENT', '2-HIGH'] WHEN '2-HIGH' THEN ['2-HIGH', '1-URGENT'] ELSE [o_orderpriority] END) AS term FROM orders
""")
def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms with those of their synonym group."""
    groups = spark.createDataFrame([(1, "1-URGENT"), (1, "2-HIGH")], "grp int, term string")
    return assembly.expand_synonyms(table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("term")), groups)
