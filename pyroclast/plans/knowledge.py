"""Queries of scalar functions, trees and retrieval (§2.8 to §2.10).

Texts are built from the tables' numbers, so the SQL side knows the answer
without reading the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.functions import geometry, numerals
from pyroclast.functions import text as T
from pyroclast.operators import hierarchy, retrieval
from pyroclast.plans.registry import query, table


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


_PAIRS = """
    words AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM texts),
    pairs AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words))
"""

_KEYWORD = (
    "WITH texts AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'q' || item_id, coalesce(text, '') FROM benchmark),"
    + _PAIRS
    + """, q AS (SELECT substr(id, 2)::BIGINT AS qid, term, count(*) OVER (PARTITION BY id) AS wanted FROM pairs WHERE id LIKE 'q%'),
    d AS (SELECT substr(id, 2)::BIGINT AS node, term FROM pairs WHERE id LIKE 'd%'),
    hits AS (SELECT qid, node, count(*) AS matched, min(wanted) AS wanted FROM q JOIN d USING (term) GROUP BY 1, 2)
"""
)


@query(_KEYWORD + "SELECT qid, 'keyword' AS route, rank::INTEGER AS rank, node FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits) WHERE rank <= 20")
def keyword_route(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share most pairs of words with each question."""
    index = retrieval.postings(table(spark, sf, "documents"), "doc_id", "text")
    return retrieval.keyword_route(index, _questions(spark, sf))


@query(_KEYWORD + "SELECT qid, 'keyword' AS route, rank::INTEGER AS rank, node FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits) WHERE rank <= 20")
def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits from postings published before a fiftieth of the documents changed, another came and others went."""
    now = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    gone = now.where("doc_id % 25 = 2").withColumn("doc_id", -k - 1)
    then = now.where("doc_id % 50 <> 1").withColumn("text", F.when(k % 50 == 0, F.concat(F.lit("as it was: "), "text")).otherwise(F.col("text"))).unionByName(gone)
    name = retrieval.publish_postings(then, "doc_id", "text")
    return retrieval.best_hits(retrieval.published_hits(name, now, "doc_id", "text", _questions(spark, sf)))


@query("""
    WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS score FROM embeddings v, q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 20
""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine to one vector; a scan and a top-k."""
    v = table(spark, sf, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = v.join(F.broadcast(one)).select("vec_id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


@query("""
    SELECT qid, 'vector' AS route, rank::INTEGER AS rank, node FROM (
        SELECT q.vec_id AS qid, v.vec_id AS node, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings v USING (label)) WHERE rank <= 20
""")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors among those that pass each question's filter."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("filter"), F.col("embedding").alias("vector"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("node")).join(v, "node").withColumnRenamed("node", "qid")
    return retrieval.vector_route(v, asked)


@query(
    _KEYWORD
    + """, k AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits),
    l AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits WHERE matched >= wanted * 0.5),
    v AS (SELECT q.vec_id AS qid, v.vec_id AS node, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
        FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings v USING (label)),
    p AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY node) - 1 AS ord FROM l WHERE node % 10 = qid % 10),
    r AS (SELECT qid, node, 'keyword' AS route, 0 AS o, 0 AS t, rank, 0.5 / (60 + rank) AS part FROM k WHERE rank <= 20
        UNION ALL SELECT qid, node, 'keyword_last', 1, 1, rank, 0.5 / (60 + rank) FROM l WHERE rank <= 20
        UNION ALL SELECT qid, node, 'vector', 5, 5, rank, 0.25 / (60 + rank) FROM v WHERE rank <= 20
        UNION ALL SELECT qid, node, 'direct', -1, 6, ord + 1, 10 - 0.01 * ord FROM p WHERE ord < 3),
    f AS (SELECT qid, node, round(sum(part), 9) AS score, min(t * 1000 + rank) AS first, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM r GROUP BY 1, 2)
    SELECT qid, rank::INTEGER AS rank, node, score, routes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, node) AS rank FROM f) WHERE rank <= 10
"""
)
def fused_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword, strict keyword, vector and pinned routes fused for every question."""
    asked = _questions(spark, sf)
    index = retrieval.postings(table(spark, sf, "documents"), "doc_id", "text")
    hits = retrieval.keyword_hits(index, asked)  # ranked by two routes; the plan computes it once
    pinned = hits.where("matched >= wanted * 0.5 AND node % 10 = qid % 10")
    pinned = retrieval.ranked(pinned, "direct", 3, F.col("node")).select("qid", (F.col("rank") - 1).alias("ord"), "node")
    routes = [retrieval.best_hits(hits), retrieval.best_hits(hits, 20, "keyword_last", 0.5), vector_topk_filtered(spark, sf)]
    return retrieval.fuse(routes, pinned).withColumn("routes", F.array_join(F.array_sort("routes"), ","))


@query(
    _KEYWORD
    + """, k AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, node) AS rank FROM hits),
    x AS (SELECT b.item_id AS qid, l.doc_id AS node, CASE WHEN b.item_id % 3 = 0 THEN 'a' ELSE 'b' END AS kind FROM benchmark b JOIN labels l ON l.doc_id % 40 = b.item_id AND l.quality = 1),
    f AS (SELECT x.qid, min(k.rank) AS rank FROM x JOIN k ON k.qid = x.qid AND k.node = x.node AND k.rank <= 5 GROUP BY 1),
    a AS (SELECT DISTINCT x.qid, kind, f.rank FROM x LEFT JOIN f ON f.qid = x.qid)
    SELECT kind, count(*) AS questions, count(*) FILTER (WHERE rank <= 3) AS hits, count(*) FILTER (WHERE rank = 1) AS top1, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr FROM a GROUP BY 1
"""
)
def hit_at_k_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """hit@3, top-1 and mean reciprocal rank by type of question."""
    answers = keyword_route(spark, sf).where("rank <= 5")
    b, good = table(spark, sf, "benchmark"), table(spark, sf, "labels").where("quality = 1").withColumn("qid", F.col("doc_id") % 40)
    kind = F.when(F.col("qid") % 3 == 0, "a").otherwise("b").alias("kind")
    expected = b.select(F.col("item_id").alias("qid")).join(good, "qid").select("qid", F.col("doc_id").alias("node"), kind)
    return retrieval.quality(answers, expected, 3, "kind")


@query("""
    SELECT bigram, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, substr(t, i, 2) AS bigram FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(1, length(coalesce(text, '')))) AS i FROM documents)) GROUP BY 1
""")
def bigram_df(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each pair of characters occurs."""
    return retrieval.pair_counts(table(spark, sf, "documents"), "text")


@query("""
    WITH known AS (SELECT DISTINCT substr(p_name, i, 2) AS b FROM (SELECT p_name, unnest(range(1, length(p_name))) AS i FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 10))),
    w AS (SELECT p_type, regexp_split_to_array(lower(p_type), '') AS c FROM (SELECT DISTINCT p_type FROM part)),
    k AS (SELECT p_type, i, c[i] AS ch, (i < len(c) AND EXISTS (SELECT 1 FROM known WHERE b = c[i] || c[i + 1])) OR (i > 1 AND EXISTS (SELECT 1 FROM known WHERE b = c[i - 1] || c[i])) AS cov FROM (SELECT p_type, c, unnest(range(1, len(c) + 1)) AS i FROM w)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY p_type, cov ORDER BY i) AS island FROM k),
    r AS (SELECT p_type, min(i) AS pos, CASE WHEN NOT cov AND count(*) >= 2 THEN ' ' ELSE string_agg(ch, '' ORDER BY i) END AS s FROM g GROUP BY p_type, cov, island),
    o AS (SELECT p_type, trim(regexp_replace(string_agg(s, '' ORDER BY pos), ' +', ' ', 'g')) AS left_over FROM r GROUP BY 1)
    SELECT p_type, CASE WHEN left_over = '' THEN lower(p_type) ELSE left_over END AS kept FROM o
""")
def unknown_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches that no known bigram covers are blanked, single characters stay."""
    p = table(spark, sf, "part")
    names = p.where("p_size > 10").select("p_name").distinct()
    known = names.select(F.explode(T.bigrams(F.col("p_name"))).alias("bigram"))
    types = retrieval.known_pairs(p.select("p_type", F.lower("p_type").alias("text")).distinct(), "text", known)
    return types.select("p_type", T.drop_unknown(F.col("text"), F.col("hits")).alias("kept"))


@query("""
    SELECT l_orderkey % 10000 AS n, (l_orderkey % 10000)::INTEGER AS back, ((l_orderkey % 99) + 1)::INTEGER AS article, CASE WHEN l_linenumber > 3 THEN l_linenumber END AS sub, l_linenumber AS paragraph, count(*) AS rows
    FROM lineitem GROUP BY ALL
""")
def numeral_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Numerals there and back, and an article reference read out of a sentence."""
    n, a, k = F.col("l_orderkey") % 10000, F.col("l_orderkey") % 99 + 1, F.col("l_linenumber")
    ref = F.concat(F.lit("依第"), numerals.to_cn(a), F.lit("條"), F.when(k > 3, F.concat(F.lit("之"), numerals.to_cn(k))).otherwise(""), F.lit("第"), k, F.lit("項規定"))
    parsed = T.article_reference(ref)
    rows = table(spark, sf, "lineitem").select(n.alias("n"), numerals.to_int(numerals.to_cn(n)).alias("back"), parsed["article"].alias("article"), parsed["sub"].alias("sub"), parsed["paragraph"].alias("paragraph"))
    return rows.groupBy("n", "back", "article", "sub", "paragraph").agg(F.count("*").alias("rows"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || 'F' WHEN 1 THEN 'B' || p_size WHEN 2 THEN p_size || 'MF' WHEN 3 THEN 'RF' WHEN 4 THEN 'R' || p_size || 'F' END AS label,
        CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN -p_size::DOUBLE WHEN 2 THEN p_size - 0.5 WHEN 3 THEN 60.0 + 1 WHEN 4 THEN 60.0 + p_size END AS elevation FROM part
""")
def floor_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and elevations of floors out of plan titles."""
    cn = numerals.to_cn(F.col("p_size"))
    m = F.col("p_partkey") % 6
    title = (
        F.when(m == 0, F.concat(cn, F.lit("層消防設備平面圖"))).when(m == 1, F.concat(F.lit("地下"), cn, F.lit("層平面圖"))).when(m == 2, F.concat(cn, F.lit("層夾層平面圖")))
        .when(m == 3, F.lit("屋頂層平面圖")).when(m == 4, F.concat(F.lit("R"), F.col("p_size"), F.lit("F 平面圖"))).otherwise(F.lit("消防系統昇位圖"))
    )
    rows = table(spark, sf, "part").select("p_partkey", T.floor_label(title).alias("label"))
    return rows.withColumn("elevation", T.elevation(F.col("label"), F.lit(60)))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 65 WHEN 1 THEN 32 WHEN 2 THEN NULL END::INTEGER AS mm, CASE WHEN p_size % 2 = 0 THEN 0.01 ELSE CASE p_partkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1.0 END END AS scale,
        (p_size + 1911 - 1) || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS day
    FROM part
""")
def drawing_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Pipe sizes, unit scales and dates counted from 1911."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pipe = F.when(k % 3 == 0, "幹管 Ø65").when(k % 3 == 1, '支管 1 1/4"').otherwise("DN66")
    unit = F.when(s % 2 == 0, " 公分 ")
    code = F.when(k % 3 == 0, 4).when(k % 3 == 1, 6).otherwise(9)
    day = F.concat_ws("/", s - 1, k % 12 + 1, k % 28 + 1)
    return table(spark, sf, "part").select("p_partkey", T.pipe_size(pipe).alias("mm"), T.unit_scale(unit, code).alias("scale"), T.roc_date(day).alias("day"))


@query("""
    SELECT o_orderkey, [(o_orderkey % 5 + 1)::INTEGER, (o_orderkey % 3 + 7)::INTEGER] AS cited, list_transform(list_sort(list_distinct([[o_orderkey % 30 + 1, 0], [12, o_orderkey % 4 + 1]])), lambda x: CASE WHEN x[2] > 0 THEN x[1] || '-' || x[2] ELSE x[1]::VARCHAR END) AS articles,
        substr(sha1('rule|' || o_orderkey || '|' || o_orderstatus), 1, 12) AS key FROM orders
""")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and articles that an answer cites, and a finding's key."""
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("依["), k % 5 + 1, F.lit("、"), k % 3 + 7, F.lit("]第"), numerals.to_cn(k % 30 + 1), F.lit("條、第12條之"), numerals.to_cn(k % 4 + 1), F.lit("及["), k % 5 + 1, F.lit("]"))
    return table(spark, sf, "orders").select("o_orderkey", T.cite_numbers(answer).alias("cited"), T.mentioned_articles(answer).alias("articles"), T.content_key(F.lit("rule"), k.cast("string"), F.col("o_orderstatus")).alias("key"))


@query("""
    SELECT o_orderkey, list_filter(c, lambda n: n BETWEEN 1 AND 4) AS valid, list_filter(c, lambda n: NOT (n BETWEEN 1 AND 4)) AS invalid,
        CASE WHEN o_orderkey % 7 IN (1, 2) THEN ['13'] ELSE list_sort(list_distinct(['13', (o_orderkey % 7 + 20)::VARCHAR])) END AS unverified
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 2 THEN [2] ELSE [(o_orderkey % 9)::INTEGER, 2] END AS c FROM orders)
""")
def answer_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Citations out of range, and articles that were not retrieved."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("id"), F.array((k % 9).cast("int"), F.lit(2)).alias("cited"), F.lit(4).alias("sources"),
        F.array((k % 7 + 20).cast("string"), F.lit("13")).alias("mentioned"), F.array(F.lit("21"), F.lit("22")).alias("allowed"),
    )
    rows = rows.withColumn("cited", F.array_distinct("cited"))
    return retrieval.verify_answers(rows).withColumnRenamed("id", "o_orderkey")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '…' ELSE text END AS clipped FROM documents")
def content_hash_and_clip(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of the text that is embedded, and the text cut for a prompt."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), T.clip(F.col("text"), 3000, "…").alias("clipped"))


@query("""
    SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR + INTERVAL 1 MINUTE AS DATE) AS VARCHAR) AS day FROM events
""")
def business_days(spark: SparkSession, sf: str) -> DataFrame:
    """The business day of each event, which changes a minute before midnight."""
    return table(spark, sf, "events").select("event_id", T.business_day(F.col("ts")).cast("string").alias("day"))


@query("""
    SELECT event_id, CASE WHEN s < 60 THEN 'less than 1 minute' WHEN s < 3600 THEN 'about ' || round_even(s / 60, 0)::INTEGER || ' minutes' ELSE 'about ' || round_even(s / 3600, 1)::DECIMAL(10, 1) || ' hours' END AS phrase
    FROM (SELECT event_id, value * 50 AS s FROM events)
""")
def duration_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting times as a phrase."""
    return table(spark, sf, "events").select("event_id", T.duration_phrase(F.col("value") * 50).alias("phrase"))


@query("""
    SELECT vec_id, '[' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.7f', round(x, 7))), ',') || ']' AS literal FROM embeddings
""")
def vector_literals(spark: SparkSession, sf: str) -> DataFrame:
    """A vector as text with seven digits."""
    return table(spark, sf, "embeddings").select("vec_id", T.vector_literal(F.col("embedding")).alias("literal"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity + 1) * (l_discount * 100 + 1), 6) AS area, round(CASE WHEN l_linenumber <= l_quantity THEN 1 ELSE 0 END * (l_quantity - l_linenumber) * l_tax * 100 / ((l_quantity * l_tax * 100) + (l_quantity * l_tax * 100) - (l_quantity - l_linenumber) * l_tax * 100), 9) AS iou,
        round(l_quantity * 2, 6) AS px FROM lineitem WHERE l_tax > 0
""")
def plane_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Shoelace areas, boxes' overlap and placed points."""
    q, d, t, k = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
    zero = F.lit(0.0)
    box = F.array(zero, zero, q + 1, d * 100 + 1)
    first, second = F.array(zero, zero, q, t * 100), F.array(k, zero, q + k, t * 100)
    spot = geometry.placed(q, zero, zero, zero, F.lit(0.0), F.lit(2.0), F.lit(1.0))
    rows = table(spark, sf, "lineitem").where("l_tax > 0")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(geometry.area(geometry.corners(box)), 6).alias("area"), F.round(geometry.iou(first, second), 9).alias("iou"), F.round(spot["x"], 6).alias("px"))


@query("""
    WITH l AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 3 AS b FROM part)
    SELECT p_partkey, CASE WHEN a = 0 OR b = 2 THEN 'void' WHEN a = 3 AND b = 1 THEN 'room' WHEN a = 3 THEN 'stair' WHEN b = 1 THEN CASE a WHEN 1 THEN 'machine' ELSE 'electrical' END
        WHEN a = 1 THEN 'mixed' ELSE 'mixed' END AS kind,
        CASE WHEN a = 0 OR b = 2 THEN false WHEN a = 3 THEN b = 0 WHEN b = 1 THEN true ELSE true END AS conflict FROM l
""")
def room_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of a room with two labels, and whether they conflict."""
    a = F.element_at(F.array(F.lit("挑空"), F.lit("機房"), F.lit("電氣室"), F.lit("辦公室")), (F.col("p_size") % 4 + 1).cast("int"))
    b = F.element_at(F.array(F.lit("樓梯間"), F.lit("會議室"), F.lit("天井")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rules = [("void", "挑空|天井"), ("machine", "機房"), ("electrical", "電氣"), ("stair", "樓梯")]
    kind = T.room_kind(F.array(a, b), rules, ["void"])
    return table(spark, sf, "part").select("p_partkey", kind["kind"].alias("kind"), kind["conflict"].alias("conflict"))


@query("""
    SELECT p_partkey, ['甲', '乙', '丙', '丁', '戊'][p_partkey % 5 + 1] || '-' || (p_size % 12 + 1) AS code, '標準第' || p_partkey || '條' || CASE WHEN p_size % 2 = 0 THEN '之' || p_size ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '第1項' ELSE '' END || '第' || p_size || '款' AS citation,
        CASE WHEN p_partkey % 3 = 0 THEN 'D2' WHEN p_partkey % 3 = 1 THEN 'D1' END AS law FROM part
""")
def codes_and_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy codes, citations of a path, and the law that an alias names."""
    k, s = F.col("p_partkey"), F.col("p_size")
    cls = F.element_at(F.array(*[F.lit(c) for c in "甲乙丙丁戊"]), (k % 5 + 1).cast("int"))
    said = F.concat(cls, F.when(k % 2 == 0, F.concat(F.lit("類場所第"), numerals.to_cn(s % 12 + 1), F.lit("目"))).otherwise(F.concat(F.lit("－"), s % 12 + 1)))
    article = F.concat(k.cast("string"), F.when(s % 2 == 0, F.concat(F.lit("-"), s)).otherwise(""))
    cite = T.citation(F.lit("標準"), article, F.array(F.lit(1), s.cast("int"), F.lit(0)), s % 3 == 0)
    question = F.element_at(F.array(F.lit("設置標準施行細則"), F.lit("設置標準第三條"), F.lit("其他")), (k % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.occupancy_code(said).alias("code"), cite.alias("citation"), T.alias_of(question, {"設置標準": "D1", "設置標準施行細則": "D2"}).alias("law"))


@query("""
    SELECT l_orderkey, pos::INTEGER AS pos, path FROM (
        SELECT DISTINCT l_orderkey, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest([[1], [1, 1], [1, 1, 1], [1, 1, 1], [1, 2], [1, 2, 0, 3]]) AS path FROM lineitem)
""")
def line_tree_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and paths of the lines of an article."""
    body = "總則\n一、第一款\n（一）第一目\n續行\n二、第二款\n3.細目"
    docs = table(spark, sf, "lineitem").select("l_orderkey").distinct().withColumn("text", F.lit(body))
    return hierarchy.line_tree(docs, "l_orderkey", "text").select("l_orderkey", "pos", "path")


@query("""
    SELECT 'L/' || l_orderkey || '/' || l_linenumber AS node, [o_orderpriority[1:3]] AS parents FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'L/' || o_orderkey, []::VARCHAR[] FROM orders
""")
def ancestor_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped texts of each node's ancestors."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("L/"), "o_orderkey").alias("node"), F.col("o_orderpriority").alias("text"))
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("L/"), "l_orderkey", F.lit("/"), "l_linenumber").alias("node")).distinct().join(table(spark, sf, "orders").select(F.concat(F.lit("L/"), "o_orderkey").alias("o")), F.regexp_extract("node", "^(L/[0-9]+)", 1) == F.col("o"), "left_semi")
    return hierarchy.parent_texts(o.unionByName(l.select("node", F.lit("x").alias("text"))), "node", "text", 3)


@query("""
    SELECT 'P/' || p_partkey || '/' || 2 AS src, unnest([0, 1, 2])::INTEGER AS ord, unnest(['前條', '第3條', '第1項']) AS raw,
        unnest([CASE WHEN p_partkey > 0 THEN 'P/' || (p_partkey - 1) END, CASE WHEN 3 <= (SELECT max(p_partkey) FROM part) THEN 'P/3' END, CASE WHEN 3 <= (SELECT max(p_partkey) FROM part) THEN 'P/3/1' END]) AS target,
        unnest([p_partkey > 0, true, true]) AS resolved FROM part
""")
def xref_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """References in texts resolved against the nodes that exist."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    previous = F.when(k > 0, (k - 1).cast("string")).otherwise("none")
    nodes = p.select(F.concat(F.lit("P/"), k, F.lit("/2")).alias("node"), previous.alias("previous"), F.lit("依前條及第3條第1項辦理").alias("text"))
    ids = p.select(F.explode(F.array(F.concat(F.lit("P/"), k), F.concat(F.lit("P/"), k, F.lit("/1")), F.concat(F.lit("P/"), k, F.lit("/2")))).alias("node"))
    return hierarchy.resolve_references(nodes, ids)


@query("""
    SELECT p_brand, CASE WHEN sum(length(r)) + count(*) - 1 <= 300 OR count(*) FILTER (WHERE hit) = 0 THEN string_agg(r, chr(10) ORDER BY r) ELSE string_agg(r, chr(10) ORDER BY r) FILTER (WHERE hit) || chr(10) || '… ' || count(*) FILTER (WHERE NOT hit) END AS shown
    FROM (SELECT DISTINCT p_brand, p_name || ':' || p_size AS r, contains('which red widget or small ring fits', p_name) AS hit FROM part) GROUP BY 1
""")
def focused_table_text(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a long table that a question is about."""
    rows = table(spark, sf, "part").select("p_brand", F.concat("p_name", F.lit(":"), "p_size").alias("r"), "p_name").distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("r", "p_name"))).alias("x"))
    texts, labels = F.transform("x", lambda s: s["r"]), F.transform("x", lambda s: s["p_name"])
    return rows.select("p_brand", retrieval.focused_rows(texts, labels, F.lit("which red widget or small ring fits"), 300).alias("shown"))


@query("""
    SELECT p_partkey, max(length(label) + hits) AS score FROM (
        SELECT p_partkey, label, (SELECT count(*) FROM (SELECT DISTINCT unnest(string_split(lower(p_type), '')) AS c) WHERE contains('economy part with a small ring', c)) AS hits
        FROM (SELECT p_partkey, p_type, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS label FROM part) WHERE length(label) >= 4 AND contains('economy part with a small ring', label))
    WHERE hits >= 2 GROUP BY 1
""")
def table_route_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Tables whose row labels a question has, scored by label length and title hits."""
    asked = F.lit("economy part with a small ring")
    p = table(spark, sf, "part").select("p_partkey", "p_type", F.explode(F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")).alias("label"))
    letters = F.array_distinct(F.filter(F.split(F.lower("p_type"), ""), lambda c: c != ""))
    hits = F.size(F.filter(letters, lambda c: F.contains(asked, c)))
    p = p.where((F.length("label") >= 4) & F.contains(asked, F.col("label"))).withColumn("hits", hits).where("hits >= 2")
    return p.groupBy("p_partkey").agg(F.max(F.length("label") + F.col("hits")).cast("long").alias("score"))


@query(r"""
    SELECT page_id, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS links FROM pages
""")
def html_block_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Title, paragraphs and links of raw pages by regular expressions, without Python."""
    h = F.col("html")
    links = F.array_distinct(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), 1))
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit("<p[ >]"), 0)).cast("long").alias("paragraphs"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


_PLACES = {"KTV": ["甲-1"], "視聽歌唱場所": ["甲-1"], "旅館": ["甲-3"], "旅館商場": ["甲-3", "甲-4"], "倉庫": ["乙-11"]}
_CODES = ["甲-1", "甲-3", "甲-4", "乙-11", "丙-1"]


@query("""
    SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '甲-1' WHEN 1 THEN '甲-3,甲-4' WHEN 2 THEN '丙-1,乙-11' ELSE '' END AS codes, ['  要滅火器', '  要滅火器', '乙、丙類場所 要滅火器', '辦公室 要滅火器'][p_partkey % 4 + 1] AS rest FROM part
""")
def place_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy codes that a question is about, and the rest of it."""
    place = F.element_at(F.array(*[F.lit(x) for x in ("KTV", "旅館商場", "乙、丙類場所", "辦公室")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = T.detect_places(F.concat(place, F.lit(" 要滅火器")), _PLACES, _CODES)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), found.alias("f")).select("id", F.array_join("f.codes", ",").alias("codes"), "f.rest")


@query("""
    SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN '丙-1,乙-11' ELSE '' END || CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN ',' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '甲-' || (p_partkey % 5) ELSE '' END AS codes
    FROM part WHERE p_partkey % 3 = 0 OR p_size % 2 = 0
""")
def occupancy_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy codes of nodes, by what they refer to and by classes that their text names."""
    p = table(spark, sf, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 3 == 0, "乙、丙類場所應設").otherwise("應設").alias("text"))
    refs = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("L/12/1/1/"), F.col("p_partkey") % 5).alias("target"))
    codes = spark.range(5).select(F.concat(F.lit("L/12/1/1/"), "id").alias("target"), F.concat(F.lit("甲-"), "id").alias("code"))
    return hierarchy.occupancy_tags(nodes, refs, codes, _CODES).select("node", F.array_join("codes", ",").alias("codes"))
