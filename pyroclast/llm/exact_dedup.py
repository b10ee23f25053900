"""Exact deduplication by skew-safe combining.

Three combining steps, each of which groups by the whole normalised text beside
its digest, so that equal digests alone never merge two texts:

1. local: Spark's map-side aggregate folds the copies that one task reads;
2. salted: what is left of a digest meets in ``salts`` groups, dealt by id;
3. global: the winners of the salts, at most ``salts`` rows a text, meet.

No step gathers rows into a list: the state of a group is a count and the best
rank so far, so a text that makes up a third of all rows costs no more than
``tasks x salts`` small rows.  Decisions return to the documents by
``(digest, salt)``, without texts; should two texts ever share a digest, exactly
those documents are joined by their text as well.

Edge cases: null text counts as empty, and all texts without content form one
group; a null id never wins against an id and is kept only if its group has no
id at all; rows that repeat an id and text count in ``group_size`` and share
one decision (:func:`deduplicate` returns one of them); an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.llm.storage import stored
from pyroclast.llm.tables import unused

#: Fixed by the contract: characters that normalisation deletes.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"

_ID_SPAN = "CAST(100000000000000000000 AS DECIMAL(38,0))"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The row that stays has the most code points in the original text, then the
    smallest id.  ``digest`` maps a text to any groupable value; it decides how
    work is dealt, never which texts are equal.
    """
    # The order (code points, -id) as one number, which aggregates in place.
    rank = F.length("text").cast("decimal(38,0)") * F.expr(_ID_SPAN) - F.col("id").cast("decimal(38,0)")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", rank.cast("decimal(38,0)").alias("rank"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("*", digest(F.col("norm")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))

    salted = rows.groupBy("digest", "salt", "norm").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    texts = salted.groupBy("digest", "norm").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    heads = stored(texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.max("rank").alias("rank")), "exact-heads")

    clashing = heads.where("texts > 1").select("digest")
    single = heads.where("texts = 1").drop("texts")
    carriers = rows.select("digest", "salt").distinct().join(single, "digest")
    small = rows.select("id", "digest", "salt", F.sha2("norm", 256).alias("text_sha256"))
    found = small.join(carriers, ["digest", "salt"])
    if not clashing.isEmpty():
        apart = rows.join(clashing, "digest", "left_semi")
        of_text = apart.groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
        found = found.unionByName(apart.withColumn("text_sha256", F.sha2("norm", 256)).drop("rank").join(of_text, ["digest", "norm"]).drop("norm"))
    span = F.expr(_ID_SPAN)
    # rank = points * span - id with |id| < span / 10; the nearest multiple of the span is points * span.
    best = F.round(F.col("rank") / span, 0).cast("decimal(38,0)")
    keep = (best * span - F.col("rank")).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group."""
    kept = assign(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha, n = unused(docs, "sha"), unused(docs, "n")
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    stay = rows.join(kept, rows[id_col].eqNullSafe(kept["__id"]) & (rows[sha] == kept["__sha"]), "left_semi")
    # Rows that repeat an id and its text are one document.
    repeated = Window.partitionBy(id_col, sha).orderBy(F.length(text_col).desc())
    return stay.withColumn(n, F.row_number().over(repeated)).where(F.col(n) == 1).select(docs.columns)
