import io
import json
import zipfile

from pyroclast.sources import readers, sinks

XML = """<Root><Law><LawName>甲法</LawName><LawURL>http://x?pcode=D0120029</LawURL><LawArticles>
<Article><ArticleType>C</ArticleType><ArticleNo></ArticleNo><ArticleContent>第一編 總則</ArticleContent></Article>
<Article><ArticleType>C</ArticleType><ArticleNo></ArticleNo><ArticleContent>第一章 通則</ArticleContent></Article>
<Article><ArticleType>A</ArticleType><ArticleNo>第 1 條</ArticleNo><ArticleContent>內容</ArticleContent></Article>
<Article><ArticleType>C</ArticleType><ArticleNo></ArticleNo><ArticleContent>第二編 分則</ArticleContent></Article>
<Article><ArticleType>A</ArticleType><ArticleNo>第 1-1 條</ArticleNo><ArticleContent>（刪除）</ArticleContent></Article>
</LawArticles></Law><Law><LawName>乙法</LawName><LawURL>http://x?pcode=B1</LawURL></Law></Root>"""


def test_laws(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    found = readers.laws(spark, f"{tmp_path}/a.xml", ["D0120029"])
    rows = readers.articles(found).orderBy("seq").collect()
    assert [(r.article, r.headings, r.deleted) for r in rows] == [("1", "第一編 總則 > 第一章 通則", False), ("1-1", "第二編 分則", True)]
    wanted = spark.createDataFrame([("D0120029",), ("Z9",)], "pcode string")
    assert [r.pcode for r in readers.missing_laws(found, wanted).collect()] == ["Z9"]


def test_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    for name in ("b c.dwg", "a.pdf"):
        (tmp_path / "up" / name).write_bytes(b"x")
    rows = readers.ingest(readers.whole_files(spark, f"{tmp_path}/up", "*")).orderBy("stored").collect()
    assert [(r.stored, r.status, r.size) for r in rows] == [("001_a.pdf", "skipped", 1), ("002_b_c.dwg", "queued", 1)]


def test_odt_legend(spark, tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:xlink="http://www.w3.org/1999/xlink"'
    cell = lambda t, i="": f"<table:table-cell><text:p>{t}</text:p>{f'<draw:image xlink:href="{i}"/>' if i else ''}</table:table-cell>"
    body = f"<table:table><table:table-row>{cell('警報')}</table:table-row><table:table-row>{cell('', 's.png')}{cell('探測器')}{cell('註', 'n.png')}</table:table-row></table:table>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}>{body}</office:document-content>")
    (tmp_path / "a.odt").write_bytes(data.getvalue())
    r = readers.legend_entries(readers.odt_tables(readers.whole_files(spark, str(tmp_path), "*.odt"))).collect()
    assert [(x.category, x.name, x.symbols, x.note_images) for x in r] == [("警報", "探測器", ["s.png"], ["n.png"])]


def test_yaml_tables(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("node_id: n1\ntitle: t\nstatus: verified\ncolumns: [a]\nrows:\n- {no: 1, place: p, marks: [a, z]}\n")
    (tmp_path / "b.yaml").write_text("node_id: n2\nstatus: draft\ncolumns: [a]\nrows:\n- {no: 1, place: p, marks: [a]}\n")
    rows = readers.yaml_tables(spark, str(tmp_path))
    assert rows.count() == 2
    assert [(r.node_id, r.broken) for r in readers.invalid_tables(rows).collect()] == [("n1", ["signed", "marks"])]


def test_drawing_and_dxf(spark, tmp_path):
    ir = {"layers": [{"name": "0", "color": 7, "on": True, "frozen": False}], "sheets": [], "texts": [{"h": "1", "t": "a", "x": 1, "y": 2, "layer": "0", "f": 0}], "inserts": [], "segments": [[0, 0, 1.5, 2, "W", 0]], "polygons": []}
    (tmp_path / "d.json").write_text(json.dumps(ir))
    tables = readers.drawing_tables(spark, f"{tmp_path}/d.json")
    assert tables["segments"].select("x2", "layer", "f").first() == (1.5, "W", 0)
    assert tables["texts"].count() == 1
    (tmp_path / "x.dxf").write_text("  0\nSECTION\n  1\nhello\nworld\n  2\nEND\n")
    rows = readers.dxf_pairs(readers.whole_files(spark, str(tmp_path), "*.dxf")).orderBy("ord").collect()
    assert [(r.code, r.value, r.repaired) for r in rows] == [(0, "SECTION", False), (1, "helloworld", True), (2, "END", False)]


def test_publish_and_csv(spark, tmp_path):
    root = f"{tmp_path}/pub"
    sinks.publish({"nodes": spark.range(3), "xrefs": spark.range(1)}, root)
    sinks.publish({"nodes": spark.range(5), "xrefs": spark.range(1)}, root)
    assert sinks.published(spark, root, "nodes").count() == 5
    sinks.csv_report(spark.createDataFrame([(2, "b"), (1, "甲")], "k int, v string"), f"{tmp_path}/csv", ["k"], ["k", "v"])
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("﻿k,v") and text.index("1,甲") < text.index("2,b")
    sinks.json_lines(spark.range(3).select("id"), f"{tmp_path}/jl", "id")
    assert spark.read.json(f"{tmp_path}/jl").count() == 3


def test_overlay(spark):
    rows = spark.createDataFrame([(1, "k2", "RED", 1.239, 2.0), (1, "k1", "BLUE", 0.0, 0.0)], "sheet int, key string, severity string, x double, y double")
    found = json.loads(sinks.overlay(rows).first().geojson)
    assert [f["properties"]["key"] for f in found["features"]] == ["k1", "k2"] and found["features"][1]["geometry"]["coordinates"] == [1.24, 2.0]
    assert sinks.tiles(spark.createDataFrame([("a", 1000, 600)], "image string, width int, height int")).groupBy("level").count().where("level = 10").first()["count"] == 4
