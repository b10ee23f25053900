"""The queries of the subpackage: each reads its whole table and applies one operator with production parameters.

``ORACLES`` has DuckDB SQL for those that SQL can express; the others are held
against brute force, round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.llm import bpe, exact_dedup, fill_in_middle, html_extraction, html_pages, importance, jaccard_join, language_id, packing, quality, secrets, substring_dedup, suffix_dedup, vptree
from pyroclast.llm.tables import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(id_col: str, folds: int) -> Column:
    """The fold of a row's id, 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without their white space."""
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; every third fold of ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_fold("doc_id", 3) != 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; every fifth fold of ids is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_fold("doc_id", 5) != 0), metadata=("n_chars",))
    found = quality.score(docs, model, threshold=0.3)
    return found.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that occur twice."""
    return suffix_dedup.summary(table(spark, sf_dir, "documents"), width=200)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 35 words that occur twice."""
    return substring_dedup.summary(table(spark, sf_dir, "documents"), width=35)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens and what they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: the base kinds, and strings that the randomness tests report."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs)
    counts = [secrets.count_of(F.col("secret_spans"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.rendered(F.col("secret_spans"), 3), 256).alias("base_sha256"), secrets.rendered(F.col("secret_spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the training sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048, end=1)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are nine tenths alike."""
    return jaccard_join.link(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of the documents whose word runs are most like those of the benchmark."""
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return importance.resample(docs, target, n=2, buckets=10_000, percent=25, least_words=20, seed=7).select("doc_id", "n_features", "weight", "score", "rank")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page, by a model of labelled pages."""
    model = html_extraction.fit(html_pages.labelled_pages(spark, 1200))
    return html_extraction.extract(table(spark, sf_dir, "pages"), model).select("page_id", "url", "text", "n_chars")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document is arranged to fill in its middle, and that it can be restored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fill_in_middle.arrange(docs, seed=7, percent=100, spm_percent=50).select("doc_id", "fim")
    fim = F.col("fim")
    chars = [F.length(fim[k]).cast("long").alias(f"{k}_chars") for k in ("prefix", "middle")]
    restored = fill_in_middle.restore(fim["output"], fim["form"])
    return found.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), *chars, F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_language_id,
        op3_nearest_vectors,
        op4_quality,
        op5_suffix_dedup,
        op6_substring_dedup,
        op7_bpe_round_trip,
        op8_secrets,
        op9_packing,
        op10_jaccard_join,
        op11_importance_resampling,
        op12_html_extraction,
        op13_fill_in_middle,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
    "op3_nearest_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    # Repeated windows of 200 bytes, as hexadecimal text; windows at most 200 apart make one removed run.
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
        t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM t)),
        r AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
        e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
        k AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM (SELECT e.doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY e.doc_id ORDER BY a, b), 1) AS p FROM e JOIN d USING (doc_id)) GROUP BY 1)
        SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1) x USING (doc_id)
    """,
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM v) WHERE c > 1),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new FROM t)),
        r AS (SELECT doc_id, run, min(i) AS a, max(i) + 35 AS b FROM g GROUP BY 1, 2),
        e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, len(w) + 1, len(w) + 1 FROM d),
        k AS (SELECT doc_id, array_to_string(flatten(list(w[p:a - 1] ORDER BY a)), ' ') AS kept FROM (SELECT e.doc_id, w, a, coalesce(lag(b) OVER (PARTITION BY e.doc_id ORDER BY a, b), 1) AS p FROM e JOIN d USING (doc_id)) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed FROM r GROUP BY 1) x USING (doc_id)
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
    """,
    # The CRC of each distinct feature, byte by byte, with the usual table of the reflected polynomial.
    "op11_importance_resampling": r"""
        WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc),
        w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
        f AS (SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
        b AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 10000 AS b
            FROM (SELECT DISTINCT f FROM f), c),
        g AS (SELECT kind, doc_id, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
        n AS (SELECT b, coalesce(sum(n) FILTER (kind = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t FROM g GROUP BY 1),
        a AS (SELECT b, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n),
        m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM g JOIN a USING (b) WHERE kind = 's' GROUP BY 1),
        h AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id) WHERE kind = 's'),
        z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM h),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
    """,
    # What stands in the one article element that each page of the given tables has; the model isn't told of it.
    "op12_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
        b AS (SELECT page_id, url, string_split_regex(regexp_replace(h, '<br>', ' ', 'g'), '</?(p|h1)>') AS b FROM a),
        t AS (SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS b FROM b),
        w AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM t)
        SELECT page_id, url, text, length(text) AS n_chars FROM w
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w FROM d),
        h AS (SELECT *, len(w)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(x, (8 * i + 1)::BIGINT, 8))::BIGINT) AS h FROM u),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
}
