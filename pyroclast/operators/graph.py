"""Connected components inside groups, such as the stairs of a building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.sources.shared import fresh


def components(nodes: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """``group, node, component``: the least node that is reachable over ``edges`` (group, a, b).

    Edges to nodes that aren't there count for nothing.  Nodes go by hashes in
    random order: each round gives one the least of itself and its neighbours and
    contracts the graph, which removes a constant share of the nodes.  All steps are joins and aggregates over
    written tables, so no group, however large, is gathered.
    """
    spark = nodes.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = fresh(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    key = lambda column: F.xxhash64(group, column)
    known = written(nodes.select(group, node).distinct().withColumn("key", key(node)))
    ends = edges.select(key("a").alias("a"), key("b").alias("b")).where("a <> b")
    for end in "ab":
        ends = ends.join(known.select(F.col("key").alias(end)), end, "left_semi")
    rest, roots = written(ends.select("a", "b").distinct()), known.select("key", F.col("key").alias("root"))
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("root"), F.least("a", "m").alias("to")))
        roots = written(roots.join(step, "root", "left").select("key", F.coalesce("to", "root").alias("root")))
        x, y = (step.select(F.col("root").alias(end), F.col("to").alias(f"{end}2")) for end in "ab")
        moved = rest.join(x, "a").join(y, "b").where("a2 <> b2")
        rest = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    named = known.join(roots, "key")
    least = named.groupBy("root").agg(F.min(node).alias("component"))
    return named.join(least, "root").select(group, node, "component")
