import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pyroclast.llm import fill_in_middle
from pyroclast.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import sha
from tests.oracle import FOLDER, connect, rows


def plainly(i, text, percent=100):
    """The arrangement of one text by Python's own means."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "\n", "\n\n\n", "one", "a\nb\nc", "a\nb\nc\n", "x<S>y\nz", "<<\n<P\nS>\n<\n<S\n>", "é\r\n🙂 日本\n\x00\n", "l\n" * 50_000, "z" * 300_000, " \t\n \n"]


@pytest.mark.parametrize("percent", [0, 60, 100])
def test_same_as_plain_python(spark, percent):
    told = [(10 * k + j, t) for k in range(8) for j, t in enumerate(TEXTS)] + [(None, "a\nb"), (3, "\n\n\n"), (3, "\n\n\n")]
    df = spark.createDataFrame(told, "doc_id long, text string").repartition(5)
    got = fill_in_middle.arrange(df, percent=percent).withColumn("back", fill_in_middle.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(told)
    for r in got:
        n, form, prefix, middle, output = plainly(r.doc_id, r.text, percent)
        assert (r.fim.n, r.fim.form, r.fim.prefix, r.fim.middle, r.fim.output) == (n, form, prefix, middle, output)
        assert r.back == (r.text or "")
    assert {r.fim.form for r in got} == ({"plain"} if not percent else {"plain", "psm", "spm"})


def test_own_units_and_sentinels(spark):
    df = spark.createDataFrame([(i, f"{i} some words, and more") for i in range(40)], "doc_id long, text string")
    own = ("⟨a⟩", "⟨b⟩", "⟨c⟩")
    got = fill_in_middle.arrange(df, units=r"\S*\s|\S+", sentinels=own).withColumn("back", fill_in_middle.restore(F.col("fim.output"), F.col("fim.form"), own)).collect()
    assert all(r.back == r.text and r.fim.n == 5 for r in got) and {r.fim.form for r in got} == {"psm", "spm"}
    lossy = fill_in_middle.arrange(df, units=r"\w+").select("fim.*").collect()  # would lose what is between words
    assert {r.form for r in lossy} == {"plain"}
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "<S>", "M"), ("<P>", "", "<M>"), ("<P>", "<<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.arrange(df, sentinels=wrong)


def test_odd_rows(odd, empty):
    got = fill_in_middle.arrange(odd.withColumn("fim_text", F.lit(1)).withColumn("FIM_UNIT", F.lit(2)), out_col="made")
    assert got.columns == [*odd.columns, "fim_text", "FIM_UNIT", "made"]
    assert sorted((r.doc_id, r.made.output) for r in got.collect()) == sorted((r.doc_id, plainly(r.doc_id, r.text)[-1]) for r in odd.collect())
    assert fill_in_middle.arrange(empty).count() == 0


def test_query(spark):
    q = QUERIES["op13_fill_in_middle"](spark, FOLDER)
    assert not re.search("Python|Arrow|Exchange", q._jdf.queryExecution().executedPlan().toString())
    got = q.toPandas()
    assert rows(got) == rows(connect().execute(ORACLES["op13_fill_in_middle"]).df())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(sha(texts[r.doc_id] or "") == r.restored_sha256 for r in got.itertuples())
