"""Joins, windows and folds that recur in knowledge-base, queue and report queries.

All of them are built from Spark's joins, aggregates and windows.  Windows are
partitioned by a key of the data; where an order over a whole table is needed
(:func:`running_count`), it is computed from totals of ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def carry_forward(df: DataFrame, value: Column, into: str, keys: list[str], *order: str) -> DataFrame:
    """``into`` holds the nearest earlier ``value`` that isn't null, the row's own included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def same_as_above(df: DataFrame, cell: str, mark: str, keys: list[str], *order: str) -> DataFrame:
    """Resolve ``mark`` to the nearest earlier real cell; ``review`` tells that the cell right above is blank."""
    before = Window.partitionBy(*keys).orderBy(*order)
    c = F.col(cell)
    real = F.when(c.isNotNull() & (c != mark), c)
    filled = F.last(real, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("resolved", F.when(c == mark, filled).otherwise(c)).withColumn("review", F.coalesce(c == mark, F.lit(False)) & F.lag(c).over(before).isNull())


def range_width(df: DataFrame, key: str, rows: int = 1_000_000) -> int:
    """Width of key ranges that hold about ``rows`` rows each where keys are evenly spread, and never more than a 64th of their span."""
    least, most, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    return 1 if least is None else max(1, (most - least + 1) // max(64, n // rows))


def running_count(df: DataFrame, key: str, width: int) -> DataFrame:
    """``ahead``: how many rows have a smaller integer ``key``.

    Ranges of ``width`` keys are counted first; only their totals are summed in
    one place, and rows are ranked inside their range.
    """
    rows = df.withColumn("__range", F.floor(F.col(key) / width))
    totals = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.rank().over(Window.partitionBy("__range").orderBy(key)) - 1
    return rows.withColumn("__inside", inside).join(bases, "__range").withColumn("ahead", (F.col("__base") + F.col("__inside")).cast("long")).drop("__range", "__base", "__inside")


def majority(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones, that seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(ordinal).alias("__first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("__n"), -F.col("__first"))).alias(value), F.max("__n").alias("votes"))


def top_values(df: DataFrame, value: str, ordinal: str, at_least: int, n: int) -> DataFrame:
    """Values seen ``at_least`` times, the ``n`` most frequent, ties by first seen."""
    counts = df.groupBy(value).agg(F.count("*").alias("times"), F.min(ordinal).alias("first_seen"))
    return counts.where(F.col("times") >= at_least).orderBy(F.desc("times"), "first_seen").limit(n)


def recompute_plan(inputs: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """``key`` and ``action``: recompute what is new or changed, delete what is gone."""
    new, old = inputs.select(key, F.col(digest).alias("__new")), existing.select(key, F.col(digest).alias("__old"))
    both = new.join(old, key, "full")
    action = F.when(F.col("__new").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "recompute")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def missing_pairs(required: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Required combinations that nothing found has."""
    return required.join(found.select(*keys).distinct(), keys, "left_anti")


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with ``reasons``; a check that is null rejects."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", failed)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; those given as None don't apply."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps, the new ones win; null counts as empty."""
    a, b = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def descendants_text(nodes: DataFrame, key: str, text: str, order: str, separator: str = "/") -> DataFrame:
    """For each node its text and all descendants' texts in order; ids are paths.

    Every node is sent to its ancestors by their ids, so the join is an equi-join.
    """
    parts = F.split(F.col(key), separator)
    ids = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    sent = nodes.select(F.explode(ids).alias("__of"), F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(text).alias("t")).alias("__x"))
    gathered = sent.groupBy("__of").agg(F.array_sort(F.collect_list("__x")).alias("__all"))
    own = nodes.select(F.col(key).alias("__of"))
    return gathered.join(own, "__of", "left_semi").select(F.col("__of").alias(key), F.array_join(F.transform("__all", lambda x: x["t"]), "").alias("full_text"))


def first_match(items: DataFrame, column: str, rules: DataFrame, exact: bool = True) -> DataFrame:
    """For each distinct value of ``column``, the first rule (ord, pattern, target) that fits: equal names first, then patterns in order.

    Values are made distinct first, and rules are a small dimension: their number
    is checked before they are sent to all tasks.
    """
    if rules.count() > 10_000:
        raise ValueError("rules are meant to be a small table")
    values = items.select(column).where(F.col(column).isNotNull()).distinct()
    fits = F.regexp_like(F.col(column), F.col("pattern"))
    tier = F.when(F.col(column) == F.col("pattern"), 0).otherwise(1) if exact else F.lit(1)
    pairs = values.join(F.broadcast(rules), (F.col(column) == F.col("pattern")) | fits)
    return pairs.groupBy(column).agg(F.min_by("target", F.struct(tier.alias("tier"), F.col("ord"))).alias("target"))
