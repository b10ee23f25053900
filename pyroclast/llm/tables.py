"""The driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
