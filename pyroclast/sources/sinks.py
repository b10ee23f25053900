"""Sinks: versioned publication, reports, logs and overlays (§2.1)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "table string, version string, at timestamp"


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables as one new version and point to it last, so readers never see half of it.

    The pointer is one small append; a failed write leaves the old version in place.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.sql("SELECT 1").select(F.lit("*").alias("table"), F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table."""
    version = spark.read.schema(_POINTER).parquet(f"{root}/pointer").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def json_lines(df: DataFrame, path: str, order: str) -> None:
    """An artifact in document order, always the same for the same rows."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def finding_rows(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per finding with its decision, building findings first, then floors.

    ``reviews``: file, floor (null for the building), key, severity, title, law (array), area.
    """
    rows = reviews.join(decisions.select("file", "key", "decision", "note"), ["file", "key"], "left")
    return rows.withColumn("place", F.coalesce("floor", F.lit(""))).withColumn("laws", F.array_join("law", "；"))


def csv_report(rows: DataFrame, path: str, order: list[str | Column], columns: list[str]) -> None:
    """CSV files with a header, in order; the first header carries a byte order mark for spreadsheets."""
    named = [F.col(c).alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(columns)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*named).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def ask_log_export(log: DataFrame, since: Column, zone: str = "Asia/Taipei") -> DataFrame:
    """Questions since a time, in local time, with their sources in order as text."""
    named = F.transform(F.array_sort(F.transform("sources", lambda s: F.struct(s["n"].alias("n"), s["citation"].alias("c")))), lambda s: F.concat(F.lit("["), s["n"], F.lit("] "), s["c"]))
    at = F.date_format(F.from_utc_timestamp("at", zone), "yyyy-MM-dd HH:mm:ss")
    return log.where(F.col("at") >= since).select("id", at.alias("at"), "question", F.array_join(named, "; ").alias("sources"), F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


def overlay(findings: DataFrame) -> DataFrame:
    """GeoJSON features of each sheet's findings: points (x, y) with two decimals."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("x", 2), F.round("y", 2)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("key", "severity").alias("properties"))
    rows = findings.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("key", feature.alias("f")))).alias("x"))
    return rows.select("sheet", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("x", lambda s: s["f"]).alias("features"))).alias("geojson"))


def tiles(images: DataFrame, size: int = 512) -> DataFrame:
    """Addresses of a tile pyramid: levels halve to one pixel."""
    top = F.ceil(F.log2(F.greatest("width", "height"))).cast("int")
    levels = images.select("image", "width", "height", top.alias("top"), F.explode(F.sequence(F.lit(0), top)).alias("level"))
    across = lambda side: F.ceil(F.ceil(F.col(side) / F.pow(F.lit(2), F.col("top") - F.col("level"))) / size).cast("int")
    rows = levels.select("image", "level", F.explode(F.sequence(F.lit(0), across("width") - 1)).alias("col"), across("height").alias("rows"))
    return rows.select("image", "level", "col", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
