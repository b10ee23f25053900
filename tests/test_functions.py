import hmac

import pytest
from pyspark.sql import functions as F

from pyroclast.functions import geometry, numerals
from pyroclast.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("十", 10), ("二十二", 22), ("一百零五", 105), ("一〇五", 105), ("兩千", 2000), ("１２", 12), ("", None), ("甲", None), (None, None), ("零", 0), ("九千九百九十九", 9999)])
def test_to_int(spark, text, value):
    assert one(spark, numerals.to_int(F.col("t").cast("string")), t=text) == value


@pytest.mark.parametrize(("n", "text"), [(0, "零"), (10, "十"), (11, "十一"), (20, "二十"), (101, "一百零一"), (1001, "一千零一"), (1010, "一千零一十"), (9999, "九千九百九十九"), (10000, None), (-1, None)])
def test_to_cn(spark, n, text):
    assert one(spark, numerals.to_cn(F.col("n")), n=n) == text


def test_all_numerals_round_trip(spark):
    rows = spark.range(10000).select("id", numerals.to_int(numerals.to_cn(F.col("id"))).alias("back"))
    assert rows.where("NOT id <=> back").count() == 0


def test_query_rewriting(spark):
    assert one(spark, T.numerals_in_query(F.col("t")), t="3樓共12000人及15台") == "三層共12000人及十五台"
    assert one(spark, T.clean_query(F.col("t"), ["請問", "請問一下"], [("滅火器", "滅火器材")], "嗎呢"), t="請問一下 滅火器　要幾個嗎") == "滅火器材 要幾個"
    known = F.transform(T.bigrams(F.col("t")), lambda b: b.isin("ab", "bc"))
    assert one(spark, T.drop_unknown(F.col("t"), known), t="abcxyabz") == "abc abz"
    assert one(spark, T.drop_unknown(F.col("t"), known), t="xyz") == "xyz"
    assert one(spark, T.drop_unknown(F.col("t"), known), t="") == ""


def test_references(spark):
    ref = T.article_reference(F.col("t"))
    assert one(spark, ref, t="依第二十二條之一第3項第二款").asDict() == {"article": 22, "sub": 1, "paragraph": 3, "item": 2, "point": None}
    assert one(spark, ref, t="無") is None
    assert one(spark, T.article_candidates(F.lit("D"), ref), t="第5條第2款") == ["D/5/1/2", "D/5/2", "D/5"]
    assert one(spark, T.mentioned_articles(F.col("t")), t="第12條、第二條之三及第12條") == ["2-3", "12"]
    assert one(spark, T.cite_numbers(F.col("t")), t="[2,3] [1、2]") == [2, 3, 1]


def test_drawing_texts(spark):
    label = T.floor_label(F.col("t"))
    for text, want in [("地下二層平面圖", "B2"), ("3F 消防設備平面圖", "3F"), ("屋突一層平面圖", "RF"), ("三層昇位圖", None), ("消防說明", None)]:
        assert one(spark, label, t=text) == want
    assert one(spark, T.pipe_size(F.col("t")), t='1-1/2" GIP') == 40
    assert one(spark, T.pipe_size(F.col("t")), t="DN66") is None
    assert one(spark, T.display_width(F.col("t")), t="a中│") == 5
    assert one(spark, T.name_norm(F.col("t")), t="侷限 （甲）， 乙") == "局限(甲),乙"
    assert one(spark, T.is_room_name(F.col("t")), t="會議室") is True
    assert one(spark, T.is_room_name(F.col("t")), t="防火門60") is False
    assert one(spark, T.is_continuation(F.col("t")), t="　續") is True
    meta = F.create_map(F.lit("圖名"), F.lit("a"), F.lit("圖號 no"), F.lit("b"), F.lit("圖號"), F.lit("c"))
    assert one(spark, T.metadata_field(meta, "圖號"), t="") == "c"


def test_tags_and_days(spark):
    assert one(spark, T.client_tag("s")(F.col("t")), t="1.2.3.4") == hmac.new(b"s", b"1.2.3.4", "sha256").hexdigest()[:12]
    day = lambda t: str(one(spark, T.business_day(F.col("t").cast("timestamp")), t=t))
    assert (day("2024-01-01 15:58:59"), day("2024-01-01 15:59:00")) == ("2024-01-01", "2024-01-02")
    assert one(spark, T.roc_date(F.col("t")), t="112年3月5日") == "20230305"
    assert one(spark, T.duration_phrase(F.col("n")), n=150) == "about 2 minutes"


def test_geometry(spark):
    box = F.array(*[F.lit(float(v)) for v in (0, 0, 4, 2)])
    assert one(spark, geometry.area(geometry.corners(box)), t=0) == 8
    assert one(spark, geometry.iou(box, F.array(*[F.lit(float(v)) for v in (2, 0, 6, 2)])), t=0) == pytest.approx(1 / 3)
    assert one(spark, geometry.within(F.array(*[F.lit(v) for v in (-0.05, 0.0, 4.0, 2.0)]), box), t=0) is True
    spot = one(spark, geometry.placed(F.lit(1.0), F.lit(0.0), F.lit(5.0), F.lit(5.0), F.lit(90.0), F.lit(2.0), F.lit(1.0)), t=0)
    assert (spot["x"], spot["y"]) == (pytest.approx(5), pytest.approx(7))


def test_all_references_and_pipe_sizes(spark):
    refs = one(spark, T.article_references(F.col("t")), t="依第12條之1第2項第3款、 十 九 條或第 一百十九 條 第 1 項及§15-2、條")
    assert [tuple(r) for r in refs] == [(12, 1, 2, 3, None), (9, None, None, None, None), (119, None, 1, None, None), (15, 2, None, None, None)]
    for text, mm in {'立管 2½"': 65, '2-1/2"': 65, '2 1/2"': 65, '2.5吋': 65, '1/2"': 15, '3/4吋': 20, "DN66": None, "65㎜": 65, "Φ100": 100, "80Amp": None, '½"': 15, '10"': None, "none": None}.items():
        assert one(spark, T.pipe_size(F.col("t")), t=text) == mm, text
