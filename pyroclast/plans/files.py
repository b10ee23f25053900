"""Queries of readers and sinks (§2.1): documents made from the tables, written where files are read, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pyroclast.plans.registry import query, table
from pyroclast.sources import readers, sinks
from pyroclast.sources.shared import fresh


def _written(rows: DataFrame, name: str) -> str:
    """A folder with one text file or more for each group ``g`` of rows (g, value)."""
    path = fresh(rows.sparkSession, name)
    rows.write.partitionBy("g").text(path)
    return path


def _laws(spark: SparkSession, sf: str) -> DataFrame:
    """A law per region: a chapter, and an article per nation."""
    article = F.concat(F.lit("<Article><ArticleType>A</ArticleType><ArticleNo>第 "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" 條</ArticleNo><ArticleContent>"), F.col("n_name"), F.lit("</ArticleContent></Article>"))
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", article.alias("a")))), lambda x: x["a"]), "\n").alias("articles"))
    rows = table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    parts = [
        F.lit("<Laws><Law><LawName>"), "r_name", F.lit("</LawName><LawURL>https://law.example/a.aspx?pcode=D00"), "r_regionkey", F.lit("</LawURL><LawArticles><Article><ArticleType>C</ArticleType><ArticleContent>第 一 章 "),
        "r_name", F.lit("</ArticleContent></Article>"), "articles", F.lit("</LawArticles></Law></Laws>"),
    ]
    return readers.laws(spark, _written(rows.select(F.col("r_regionkey").alias("g"), F.concat(*parts).alias("value")), "laws"), [f"D00{k}" for k in range(4)])


@query("""
    SELECT 'D00' || n_regionkey AS pcode, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS seq, (n_nationkey + 1)::VARCHAR AS article, '第 一 章 ' || r_name AS headings, n_name AS text, false AS deleted
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 4
""")
def law_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Laws of an XML dump that are wanted, as articles in order under their headings."""
    return readers.articles(_laws(spark, sf))


@query("SELECT 'D00' || r_regionkey AS pcode FROM region WHERE r_regionkey >= 4")
def laws_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Configured laws that the dump lacks."""
    return readers.missing_laws(_laws(spark, sf), table(spark, sf, "region").select(F.concat(F.lit("D00"), "r_regionkey").alias("pcode")))


@F.pandas_udf(BinaryType())
def _odt(names: pd.Series, regions: pd.Series) -> pd.Series:
    """A document with one table: a category row, and a row of a symbol and a name."""
    names_of = " ".join(f'xmlns:{k}="{v}"' for k, v in readers._ODF.items())

    def one(name: str, region: str) -> bytes:
        cell = lambda inner: f"<table:table-cell>{inner}</table:table-cell>"
        image = f'<draw:frame><draw:image xlink:href="{name}.png"/></draw:frame>'
        rows = [cell(f"<text:p>{region}</text:p>"), cell(image) + cell(f"<text:p>{name}</text:p>")]
        body = "".join(f"<table:table-row>{r}</table:table-row>" for r in rows)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("content.xml", f"<office:document {names_of}><table:table>{body}</table:table></office:document>")
        return out.getvalue()

    return pd.Series([one(n, r) for n, r in zip(names, regions, strict=True)])


@query("SELECT n_nationkey || '.odt' AS path, r_name AS category, n_name AS name, n_name || '.png' AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
def odt_legend(spark: SparkSession, sf: str) -> DataFrame:
    """Legend entries of tables in ODT files, with categories carried forward."""
    files = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_nationkey", F.lit(".odt")).alias("path"), _odt("n_name", "r_name").alias("content"))
    return readers.legend_entries(readers.odt_tables(files)).select("path", "category", "name", F.get("symbols", F.lit(0)).alias("symbol"))


@query("""
    SELECT 'N/' || s_suppkey AS node_id, list_filter([CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 THEN 'signed' END, CASE WHEN s_suppkey % 5 = 0 THEN 'marks' END], lambda x: x IS NOT NULL) AS broken FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 OR s_suppkey % 5 = 0
""")
def yaml_tables(spark: SparkSession, sf: str) -> DataFrame:
    """YAML tables, and the rules that each of them breaks."""
    s = F.col("s_suppkey")
    signed = F.when(s % 3 == 0, F.lit("\nverified_by: me\nverified_at: 2026-01-02")).otherwise("")
    text = F.concat(F.lit("node_id: N/"), s, F.lit("\ntitle: t\nstatus: "), F.when(s % 2 == 0, "verified").otherwise("draft"), signed, F.lit("\ncolumns: [a, b]\nrows:\n- {no: 1, place: p, marks: ["), F.when(s % 5 == 0, "c").otherwise("a"), F.lit("]}\n"))
    return readers.invalid_tables(readers.yaml_rows(table(spark, sf, "supplier").select(text.alias("value")))).select("node_id", "broken")


@query("SELECT 'N/' || o_orderkey AS node_id, o_orderstatus AS level, [o_custkey % 7, o_orderkey % 5]::INTEGER[] AS path, o_orderpriority AS text, o_orderkey % 2 = 0 AS deleted, (o_orderkey % 1000)::INTEGER AS seq FROM orders")
def node_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes written as JSON lines in order, and read with their schema."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.concat(F.lit("N/"), k).alias("node_id"), F.col("o_orderstatus").alias("level"), F.array((F.col("o_custkey") % 7).cast("int"), (k % 5).cast("int")).alias("path"), F.col("o_orderpriority").alias("text"), (k % 2 == 0).alias("deleted"), (k % 1000).cast("int").alias("seq"))
    path = fresh(spark, "nodes")
    sinks.json_lines(rows, path, "node_id")
    return readers.nodes(spark, path).select(rows.columns)


@query("SELECT n_name AS name, n_regionkey::INTEGER AS category FROM nation")
def legend_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """A10: artifacts that are one JSON array each."""
    entries = F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("category")))
    path = _written(table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("g")).agg(F.to_json(entries).alias("value")), "legend")
    return readers.json_array(spark, path, "name string, category int").select("name", "category")


@query("""
    SELECT n_nationkey::VARCHAR AS part, 'insert' AS kind, s_name AS name, (s_suppkey % 50)::DOUBLE AS x, s_nationkey::INTEGER AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_nationkey::VARCHAR, 'segment', 'WALL', (s_suppkey % 50)::DOUBLE, s_nationkey::INTEGER FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def drawing_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts and positional segments of drawing documents."""
    s, g = F.col("s_suppkey"), F.col("s_nationkey")
    x = (s % 50).cast("double")
    insert = F.struct(s.cast("string").alias("h"), F.col("s_name").alias("name"), x.alias("x"), F.lit(1.0).alias("y"), F.lit("FP").alias("layer"), g.cast("int").alias("f"))
    segment = F.array(x.cast("string"), F.lit("0.0"), F.lit("2.5"), F.lit("0.0"), F.lit("WALL"), g.cast("string"))
    docs = table(spark, sf, "supplier").groupBy(g.alias("g")).agg(F.to_json(F.struct(F.collect_list(insert).alias("inserts"), F.collect_list(segment).alias("segments"))).alias("value"))
    tables = readers.drawing_tables(spark, _written(docs, "drawings"))
    inserts = tables["inserts"].select(F.col("f").cast("string").alias("part"), F.lit("insert").alias("kind"), "name", "x", "f")
    return inserts.unionByName(tables["segments"].select(F.col("f").cast("string").alias("part"), F.lit("segment").alias("kind"), F.col("layer").alias("name"), F.col("x1").alias("x"), "f"))


@query("""
    SELECT s_suppkey || '.dxf' AS path, 0::INTEGER AS ord, 0::INTEGER AS code, 'TEXT' AS value, false AS repaired FROM supplier
    UNION ALL SELECT s_suppkey || '.dxf', 1, 1, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' torn' ELSE '' END, s_suppkey % 2 = 0 FROM supplier
    UNION ALL SELECT s_suppkey || '.dxf', 2, 8, 'WALL', false FROM supplier
""")
def dxf_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a drawing text; a torn line goes back to the value before it."""
    s = F.col("s_suppkey")
    lines = [F.lit("  0"), F.lit("TEXT"), F.lit("  1"), F.col("s_name"), F.when(s % 2 == 0, " torn"), F.lit("  8"), F.lit("WALL")]
    files = table(spark, sf, "supplier").select(F.concat(s, F.lit(".dxf")).alias("path"), F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("content"))
    return readers.dxf_pairs(files)


@query("""
    WITH f AS (SELECT s_nationkey AS n, s_suppkey AS k, s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ' 表.txt' ELSE ' 圖 1.dwg' END AS name FROM supplier)
    SELECT '/in/' || n || '/' || name AS path, lpad((rank() OVER (PARTITION BY n ORDER BY '/in/' || n || '/' || name))::VARCHAR, 3, '0') || '_' || replace(name, ' ', '_') AS stored, sha256(name) AS sha256, strlen(name) AS size,
        CASE WHEN k % 3 = 0 THEN 'skipped' ELSE 'queued' END AS status, CASE WHEN k % 3 = 0 THEN 'not a drawing' END AS error FROM f
""")
def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of a case with safe names, digests and first states."""
    s = F.col("s_suppkey")
    name = F.concat(s, F.when(s % 3 == 0, " 表.txt").otherwise(" 圖 1.dwg"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("/in/"), "s_nationkey", F.lit("/"), name).alias("path"), F.octet_length(name).cast("long").alias("length"), F.encode(name, "UTF-8").alias("content"))
    return readers.ingest(files)


@query("""
    SELECT l_suppkey AS sheet, count(*)::INTEGER AS features, (min({'k': l_orderkey * 10 + l_linenumber, 'x': l_quantity})).k::VARCHAR AS first, round((min({'k': l_orderkey * 10 + l_linenumber, 'x': l_quantity})).x, 2)::DOUBLE AS x FROM lineitem GROUP BY 1
""")
def geojson_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each sheet as GeoJSON, by features and the first one's key and place."""
    findings = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.lit("RED").alias("severity"), F.col("l_quantity").cast("double").alias("x"), F.lit(1.0).alias("y"))
    made = sinks.overlay(findings)
    part = lambda p: F.get_json_object("geojson", p)
    return made.select("sheet", F.json_array_length(part("$.features")).alias("features"), part("$.features[0].properties.key").alias("first"), part("$.features[0].geometry.coordinates[0]").cast("double").alias("x"))


@query("SELECT 'nation' AS kind, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def bulk_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Several tables published as one version, twice, and the current version read."""
    root = fresh(spark, "publication")
    nation = table(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    region = table(spark, sf, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    sinks.publish({"nation": nation.limit(0), "region": region.limit(0)}, root)
    sinks.publish({"nation": nation, "region": region}, root)
    return sinks.published(spark, root, "nation").unionByName(sinks.published(spark, root, "region"))
