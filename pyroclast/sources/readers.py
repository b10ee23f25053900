"""Readers of laws, tables, legends and drawings (§2.1).

Schemas are declared, never inferred.  What Spark has a reader for is read by
it; other formats come in as whole files and are parsed by Arrow or pandas
batches on the executors, one file a row.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.operators.relational import carry_forward

LAW = """LawName string, LawURL string, LawModifiedDate string, LawEffectiveDate string, LawAbandonNote string,
    LawArticles struct<Article: array<struct<ArticleType: string, ArticleNo: string, ArticleContent: string>>>"""

NODES = "node_id string, pcode string, article string, level string, path array<int>, text string, parent_id string, citation string, chapter string, deleted boolean, seq int"

IR = """layers array<struct<name: string, color: int, on: boolean, frozen: boolean>>,
    sheets array<struct<idx: int, bbox: array<double>, meta: map<string, string>, role: string>>,
    texts array<struct<h: string, t: string, x: double, y: double, layer: string, f: int>>,
    inserts array<struct<h: string, name: string, x: double, y: double, rot: double, layer: string, attribs: map<string, string>, f: int>>,
    segments array<array<string>>, polygons array<struct<h: string, layer: string, f: int, area: double, pts: array<array<double>>>>"""


def laws(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Laws of an XML dump with their code, those ``wanted`` only."""
    rows = spark.read.format("xml").option("rowTag", "Law").schema(LAW).load(path)
    rows = rows.withColumn("pcode", F.regexp_extract("LawURL", "pcode=([A-Z0-9]+)", 1))
    return rows if wanted is None else rows.where(F.col("pcode").isin(wanted))


def missing_laws(laws_: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured codes that the dump lacks; a load goes on only if there is none."""
    return configured.select("pcode").join(laws_.select("pcode"), "pcode", "left_anti")


def articles(laws_: DataFrame) -> DataFrame:
    """One row per article in order, with the headings that hold for it."""
    rows = laws_.select("pcode", F.posexplode("LawArticles.Article").alias("seq", "a")).select("pcode", "seq", F.col("a.ArticleType").alias("type"), F.col("a.ArticleNo").alias("no"), F.trim("a.ArticleContent").alias("text"))
    heading = F.col("type") == "C"
    # An outer heading voids the inner ones: each level carries the row it was set at.
    for name, pattern in (("part", "^第[^編章節]*編"), ("chapter", "^第[^編章節]*章"), ("section", "^第[^編章節]*節")):
        rows = carry_forward(rows, F.when(heading & F.col("text").rlike(pattern), F.struct("seq", "text")), f"__{name}", ["pcode"], "seq")
    after = lambda inner, *outer: F.when(F.greatest(*[F.coalesce(F.col(f"__{o}.seq"), F.lit(-1)) for o in outer], F.lit(-1)) < F.col(f"__{inner}.seq"), F.col(f"__{inner}.text"))
    path = F.array_join(F.filter(F.array(F.col("__part.text"), after("chapter", "part"), after("section", "part", "chapter")), lambda x: x.isNotNull()), " > ")
    article = F.regexp_replace(F.regexp_extract("no", r"第\s*([0-9-]+)\s*條", 1), " ", "")
    return rows.withColumn("headings", path).where(~heading).select("pcode", "seq", article.alias("article"), "headings", "text", (F.col("text") == "（刪除）").alias("deleted"))


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path`` and ``content`` of every file, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def ingest(files: DataFrame) -> DataFrame:
    """Uploads with a safe stored name, digest and first state; other formats than drawings are skipped with the reason."""
    name = F.element_at(F.split("path", "/"), -1)
    drawing = F.lower(name).rlike(r"\.(dwg|dxf)$")
    safe = F.concat(F.lpad(F.rank().over(_in_order()).cast("string"), 3, "0"), F.lit("_"), F.regexp_replace(name, r"(?U)[^\w.-]+", "_"))
    return files.select("path", safe.alias("stored"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.when(drawing, "queued").otherwise("skipped").alias("status"), F.when(~drawing, "not a drawing").alias("error"))


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).orderBy("path")


def html_blocks(pages: DataFrame, key: str, html: str, tag: str = "pre") -> DataFrame:
    """Text of each block of a page in order, without tags and entities, wrapped lines joined."""
    blocks = F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    rows = pages.select(key, F.posexplode(blocks).alias("ord", "raw"))
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    joined = F.regexp_replace(plain, "(?<=[^\\n。：])\\n(?=[^\\n一二三四五六七八九十（(0-9])", "")
    return rows.select(key, "ord", F.trim(joined).alias("text"))


_ODF = {"office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "draw": "urn:oasis:names:tc:opendocument:xmlns:drawing:1.0", "xlink": "http://www.w3.org/1999/xlink"}


def odt_tables(files: DataFrame) -> DataFrame:
    """Rows of the tables in ODT files: texts and image references of their cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml"))
                for t, table in enumerate(tree.iterfind(".//table:table", _ODF)):
                    for r, row in enumerate(table.iterfind(".//table:table-row", _ODF)):
                        cells = row.findall("table:table-cell", _ODF)
                        texts = ["".join("".join(p.itertext()) for p in c.iterfind(".//text:p", _ODF)).strip() for c in cells]
                        images = [[i.get(f"{{{_ODF['xlink']}}}href") for i in c.iterfind(".//draw:image", _ODF)] for c in cells]
                        out.append((path, t, r, texts, images))
            yield pd.DataFrame(out, columns=["path", "table", "row", "texts", "images"])

    return files.select("path", "content").mapInPandas(run, "path string, table int, row int, texts array<string>, images array<array<string>>")


def legend_entries(rows: DataFrame) -> DataFrame:
    """Legend entries of table rows: a row of one cell is a category, the first cell with a text the name, images left of it the symbols."""
    first = F.array_position(F.transform("texts", lambda t: t != ""), True).cast("int")
    marked = rows.withColumn("first", first).withColumn("category", F.when(F.size("texts") == 1, F.get("texts", F.lit(0))))
    kept = carry_forward(marked, F.col("category"), "category", ["path", "table"], "row").where((F.size("texts") > 1) & (F.col("first") > 0))
    return kept.select("path", "table", "row", "category", F.element_at("texts", F.col("first")).alias("name"), F.flatten(F.slice("images", F.lit(1), F.col("first") - 1)).alias("symbols"), F.flatten(F.slice("images", F.col("first") + 1, F.size("images"))).alias("note_images"))


TABLE = "node_id string, title string, status string, verified_by string, verified_at string, columns array<string>, rows array<struct<no: int, place: string, marks: array<string>>>"


def yaml_tables(spark: SparkSession, path: str) -> DataFrame:
    """YAML table documents of a folder as rows of ``TABLE``."""
    return yaml_rows(spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True))


def yaml_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of ``TABLE`` from YAML texts."""

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        import yaml

        return texts.map(lambda t: json.dumps(yaml.safe_load(t), default=str, ensure_ascii=False))

    return texts.select(F.from_json(as_json(column), TABLE).alias("t")).select("t.*")


def invalid_tables(tables: DataFrame) -> DataFrame:
    """Table documents that break a rule, with the rules' names."""
    rules = {
        "keys": F.col("node_id").isNotNull() & F.col("columns").isNotNull() & F.col("rows").isNotNull(),
        "status": F.col("status").isin("draft", "verified"),
        "signed": (F.col("status") != "verified") | (F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull()),
        "marks": ~F.exists("rows", lambda r: F.size(F.array_except(F.coalesce(r["marks"], F.array().cast("array<string>")), F.col("columns"))) > 0),
    }
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return tables.withColumn("broken", failed).where(F.size("broken") > 0)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node artifacts, a JSON object a line."""
    return spark.read.schema(NODES).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artifact that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def drawing_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of drawings' IR documents, keyed by file and place in the document."""
    docs = spark.read.schema(IR).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    out = {t: docs.select("file", F.posexplode(t).alias("ord", "x")).select("file", "ord", "x.*") for t in ("layers", "sheets", "texts", "inserts", "polygons")}
    s = docs.select("file", F.posexplode("segments").alias("ord", "x"))
    # Segments are positional: x1, y1, x2, y2, layer, sheet.
    out["segments"] = s.select("file", "ord", *[F.col("x")[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("x")[4].alias("layer"), F.col("x")[5].cast("int").alias("f"))
    return out


def dxf_pairs(files: DataFrame) -> DataFrame:
    """(code, value) pairs of DXF texts in order; a line that should be a code but isn't belongs to the value before it.

    A file is read line by line in one task, since each pair depends on those before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                lines = content.decode("utf-8", "replace").splitlines()
                codes, values, repaired, i = [], [], [], 0
                while i + 1 < len(lines):
                    if re.fullmatch(r"\s*-?\d+\s*", lines[i]):
                        codes.append(int(lines[i]))
                        values.append(lines[i + 1])
                        repaired.append(False)
                        i += 2
                    else:
                        if values:
                            values[-1] += lines[i]
                            repaired[-1] = True
                        i += 1
                yield pd.DataFrame({"path": path, "ord": range(len(codes)), "code": codes, "value": values, "repaired": repaired})

    return files.select("path", "content").mapInPandas(run, "path string, ord int, code int, value string, repaired boolean")
