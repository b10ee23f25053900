import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyroclast.llm import html_extraction as ex
from pyroclast.llm.html_blocks import blocks
from pyroclast.llm.html_pages import composed, labelled_pages
from pyroclast.llm.queries import ORACLES, QUERIES
from tests.oracle import FOLDER, connect, rows


@pytest.fixture(scope="module")
def model(spark):
    return ex.fit(labelled_pages(spark, 1200))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a<p>b <b>c</b><div>d</div>e") == ["a", "b c", "d", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<br>b</p>\n c\t d <hr> e") == ["a b", "c d", "e"]
    assert texts("x<!-- <p>no</p> -->y<script>if(a<b)'</p>'</SCRIPT >z<style>p{}</style>") == ["xyz"]
    assert texts("&lt;p&gt; &amp;amp; &eacute;&#32;&#x65e5;&nbsp;x &unknown; & &am") == ["<p> &amp; é 日 x &unknown; & &am"]
    assert texts("a < b <3 > <p title='x>y' class=k>c<q>d</q>") == ["a < b <3 >", "cd"]
    assert texts("<p>a</i></span>b</div>c") == ["ab", "c"]
    assert texts("<b>x<div>y</b>z</div>") == ["x", "yz"]
    assert texts("") == texts("<p></p><div> \n</div>") == texts("<textarea>a</textarea><button>b</button><noscript>c</noscript>") == []
    assert texts("<script>never ended <p>x") == texts("<!-- never ended <p>x") == []
    b = blocks('<div id="mainMenu" class=\'top nav-bar\'><p>one <a href=x>two</a></p></div>')[0]
    assert b.above == {"<div", "<p", "main", "menu", "top", "nav", "bar"} and (b.linked, b.tag) == (3, "p")


def test_blocks_of_large_pages():
    assert len(texts("<div>" * 30_000 + "x" + "</div>" * 30_000)) == 1
    assert len(texts("<p>x" * 100_000)) == 100_000
    assert texts("<a \"" * 50_000 + "x")[0].endswith("x") and len(texts("<" * 200_000)) == 1
    assert len(texts("<p>" + "word " * 1_000_000)[0]) == 4_999_999
    assert len(texts("<b>" * 20_000 + "<p>x</p>" * 2_000)) == 2_000


def test_chain_against_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        unary, pair, ends = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=(2, 2))
        score = {y: sum(u for u, k in zip(unary, y, strict=True) if k) + sum(pair[a, b] for a, b in itertools.pairwise(y)) + ends[0, y[0]] + ends[1, y[-1]] for y in itertools.product((0, 1), repeat=n)}
        assert tuple(ex.best(list(unary), pair, ends)) == max(score, key=score.get)
        total = np.logaddexp.reduce(list(score.values()))
        padded, there = np.zeros((2, 7)), np.zeros((2, 7), bool)
        padded[0, :n], there[0, :n], there[1, :3] = unary, True, True
        z, single, both = ex.marginals(padded, there, pair, ends)
        assert np.isclose(z[0], total)
        for t in range(n):
            assert np.isclose(single[0, t, 1], sum(np.exp(s - total) for y, s in score.items() if y[t]))
        for a, b in itertools.product((0, 1), repeat=2):
            assert np.isclose(both[0, a, b], sum(np.exp(s - total) * list(itertools.pairwise(y)).count((a, b)) for y, s in score.items()))


def test_held_out_pages(model):
    """Pages of other seeds: nearly every block gets its label, and most pages are exact."""
    wrong = exact = many = 0
    for seed in range(77_000_000, 77_000_300):
        page, text = composed(seed)
        found = ex.labelled_blocks(page, model)
        want = ex.labels_of([b for b, _ in found], text)
        assert sum(want) == text.count("\n") + 1
        wrong += sum(y != w for (_, y), w in zip(found, want, strict=True))
        many += len(want)
        exact += ex.main_text(found) == text
    assert wrong / many < 0.005 and exact / 300 > 0.95


def test_usual_parts(model):
    page = """<html><body><header><a href=/>My site</a></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
        <article><h1>A title</h1><p>First   paragraph, with <a href=/x>a link</a> &amp; more.</p><div class="ad">Buy this now, it is good.</div><p>Short.</p><aside>Read more elsewhere.</aside>
        <form><label>Mail</label><button>Go</button></form><p>Last paragraph here.</p><section id="comments"><p>I liked this very much, thanks.</p><p>Me too.</p></section></article>
        <aside class="sidebar"><p>Other news of the day.</p></aside><footer><p>© 2024 Somebody. All rights reserved.</p></footer>"""
    assert ex.main_text(ex.labelled_blocks(page, model)) == "A title\nFirst paragraph, with a link & more.\nShort.\nLast paragraph here."


def test_labels_are_the_last_fit():
    found = blocks("<nav>Title</nav><h1>Title</h1><p>a</p><p>b</p><footer>c</footer>")
    assert ex.labels_of(found, "Title\na\nb") == [0, 1, 1, 1, 0]
    assert ex.labels_of(found, "") == [0] * 5


def test_odd_rows(spark, model):
    told = [(1, None, None), (2, "u", ""), (3, "u", "plain words only"), (4, "u", "<nav>only a menu</nav>"), (5, "u", "<p>x</p>"), (5, "u", "<p>x</p>"), (None, "v", "<article><p>" + "long " * 200_000), (6, "w", "\x00<p>é🙂</p>")]
    df = spark.createDataFrame(told, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("c0", F.lit("x")).repartition(3)
    got = {(r.page_id, r.html): r for r in ex.extract(df, model, keep=("page_id", "url", "html")).collect()}
    assert got[1, None].text == got[2, ""].text == got[4, told[3][2]].text == "" and got[1, None].n_chars == 0
    assert got[None, told[6][2]].n_chars == 5 * 200_000 - 1
    assert ex.extract(df, None).where("page_id = 4").first().text == "only a menu"
    assert ex.fit(spark.createDataFrame([], "html string, text string")) is None
    assert ex.fit(spark.createDataFrame([(None, "a"), ("<p>", None)], "html string, text string")) is None
    assert ex.fit(spark.createDataFrame([("", "a"), ("<p>x</p>", "x"), ("<p>x</p>", "x")], "html string, text string"), least_pages=1).weight
    assert ex.extract(df.where("false"), model).count() == 0


def test_query(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        got = QUERIES["op12_html_extraction"](spark, folder).toPandas()
        assert rows(got) == rows(connect(folder).execute(ORACLES["op12_html_extraction"]).df())
