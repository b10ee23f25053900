"""Queries of document parsers and reports (§2.1, §2.9) on texts derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.operators import boxtable
from pyroclast.plans.registry import query, table
from pyroclast.sources import readers, sinks


@query("""
    SELECT n_nationkey, row, col, row_span, col_span, text FROM (
        SELECT n_nationkey, unnest([0, 0, 1])::INTEGER AS row, unnest([0, 1, 1])::INTEGER AS col, unnest([2, 1, 1])::INTEGER AS row_span, unnest([1, 1, 1])::INTEGER AS col_span, unnest([n_name, 'k' || n_nationkey, 'r' || n_regionkey]) AS text FROM nation)
""")
def box_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a table drawn with box characters, with spans."""
    pad = lambda c, n: F.rpad(c, n, " ")
    bar = "─" * 6
    name, key, region = pad(F.col("n_name"), 12), pad(F.concat(F.lit("k"), "n_nationkey"), 12), pad(F.concat(F.lit("r"), "n_regionkey"), 12)
    lines = [F.lit("head"), F.lit(f"┌{bar}┬{bar}┐"), F.concat(F.lit("│"), name, F.lit("│"), key, F.lit("│")), F.lit(f"│{' ' * 12}├{bar}┤"), F.concat(F.lit("│"), pad(F.lit(""), 12), F.lit("│"), region, F.lit("│")), F.lit(f"└{bar}┴{bar}┘"), F.lit("tail")]
    docs = table(spark, sf, "nation").select("n_nationkey", F.concat_ws("\n", *lines).alias("text"))
    return boxtable.table_cells(boxtable.segments(docs, "n_nationkey", "text"), "n_nationkey").select("n_nationkey", "row", "col", "row_span", "col_span", "text")


@query("""
    SELECT page_id, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>')) AS items FROM pages WHERE len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>')) > 0
""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all blocks of a tag."""
    blocks = readers.html_blocks(table(spark, sf, "pages"), "page_id", "html", "li")
    return blocks.groupBy("page_id").agg(F.count("*").alias("items"))


@query("""
    SELECT 'img' || p_partkey AS image, level, ceil(ceil((p_size * 40)::DOUBLE / pow(2, top - level)) / 512)::BIGINT * ceil(ceil(700::DOUBLE / pow(2, top - level)) / 512)::BIGINT AS tiles
    FROM (SELECT *, unnest(range(0, top + 1))::INTEGER AS level FROM (SELECT *, ceil(log2(greatest(p_size * 40, 700)))::INTEGER AS top FROM part))
""")
def tile_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """How many tiles each level of a drawing has."""
    images = table(spark, sf, "part").select(F.concat(F.lit("img"), "p_partkey").alias("image"), (F.col("p_size") * 40).alias("width"), F.lit(700).alias("height"))
    return sinks.tiles(images).groupBy("image", "level").agg(F.count("*").alias("tiles"))


@query("""
    SELECT o_orderkey AS id, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS at, o_orderpriority AS question, '[1] a; [2] ' || o_orderstatus AS sources, '2,' || (o_orderkey % 3) AS cited FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
""")
def ask_log_export(spark: SparkSession, sf: str) -> DataFrame:
    """The log of questions as flat rows in local time."""
    sources = F.array(F.struct(F.lit(2).alias("n"), F.col("o_orderstatus").alias("citation")), F.struct(F.lit(1).alias("n"), F.lit("a").alias("citation")))
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("question"), sources.alias("sources"), F.array(F.lit(2), (F.col("o_orderkey") % 3).cast("int")).alias("cited"))
    return sinks.ask_log_export(log, F.lit("1997-01-01").cast("timestamp"))


@query("""
    SELECT l_orderkey AS file, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, CASE WHEN l_linenumber > 1 THEN l_linenumber || 'F' ELSE '' END AS place, l_returnflag || '；' || l_linestatus AS laws, CASE WHEN bool_or(l_discount > 0.07) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) THEN 'rejected' END AS decision FROM lineitem
""")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with decisions, one row each."""
    l = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    reviews = l.select(F.col("l_orderkey").alias("file"), key, F.when(F.col("l_linenumber") > 1, F.concat("l_linenumber", F.lit("F"))).alias("floor"), F.array("l_returnflag", "l_linestatus").alias("law"))
    decisions = l.where("l_discount > 0.07").select(F.col("l_orderkey").alias("file"), key).distinct().select("file", "key", F.lit("rejected").alias("decision"), F.lit("").alias("note"))
    return sinks.finding_rows(reviews, decisions).select("file", "key", "place", "laws", "decision")
