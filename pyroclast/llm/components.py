"""Connected components of a distributed edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyroclast.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every end of ``edges`` (columns ``a`` and ``b``, longs).

    Each round gives a node the least of itself and its neighbours and contracts
    the graph to these.  Ids that are hashes are in random order, so a round
    removes a constant share of the nodes.  Every step groups or joins by node;
    nothing is gathered.
    """
    rest = stored(edges.where("a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "steps")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = rest.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        rest = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
