"""Queues, quotas and decisions as batch operators over logs (§2.13).

A log of events is the source of truth, the state is its latest row per key, and
one writer applies a batch; there are no row locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyroclast.functions.text import business_day
from pyroclast.operators.relational import latest_per_key

# Attempts before a job fails, failures and seconds of the lockout, starts and seconds of the login limit.
MAX_ATTEMPTS = 3
LOCKOUT = (10, 3600)
STARTS = (60, 600)


def claim(jobs: DataFrame, slots: int, newest: bool = False) -> DataFrame:
    """The ``slots`` first queued jobs (id, status, attempts), now processing."""
    order = F.desc("id") if newest else F.asc("id")
    return jobs.where("status = 'queued'").orderBy(order).limit(slots).withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def recover_stale(jobs: DataFrame, now: Column, older_than_s: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs whose lease ran out are queued again, or failed after ``max_attempts``."""
    stale = F.col("status").isin("processing", "reviewing") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(older_than_s)))
    return jobs.withColumn("status", F.when(stale & (F.col("attempts") < max_attempts), "queued").when(stale, "failed").otherwise(F.col("status")))


def apply_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Results (id, gen, state) apply only to the generation that asked for them; late ones are dropped."""
    late = results.select("id", F.col("gen").alias("__gen"), F.col("state").alias("__state"))
    rows = jobs.join(latest_per_key(late, ["id"], F.desc("__gen")), "id", "left")
    return rows.withColumn("state", F.when(F.col("gen") == F.col("__gen"), F.col("__state")).otherwise(F.col("state"))).drop("__gen", "__state")


def snapshot(log: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """The latest row of each key; a null value is a tombstone."""
    return latest_per_key(log, keys, order).where(F.col(value).isNotNull())


#: States and what may follow them.
NEXT = {"queued": ["processing", "skipped"], "processing": ["reviewing", "queued", "failed"], "reviewing": ["done", "queued", "failed"], "done": ["queued"], "failed": ["queued"]}


def illegal_transitions(log: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a state log that don't follow from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    rows = log.withColumn("before", F.lag("status").over(w))
    return rows.where(F.col("before").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False)))


def daily_quota(requests: DataFrame, ts: str, order: str, limit: int, client: list[str] | None = None) -> DataFrame:
    """Which requests a business day's quota lets through, in order; none if the limit isn't positive."""
    rows = requests.withColumn("day", business_day(F.col(ts)))
    w = Window.partitionBy("day", *(client or [])).orderBy(order)
    return rows.withColumn("accepted", (F.row_number().over(w) <= limit) & F.lit(limit > 0))


def sliding_lockout(tries: DataFrame, client: str, ts: str, failed: Column, most: int = LOCKOUT[0], seconds: int = LOCKOUT[1]) -> DataFrame:
    """Whether a client is blocked at each try: ``most`` failures in the ``seconds`` before it."""
    w = Window.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    failures = F.coalesce(F.sum(failed.cast("int")).over(w), F.lit(0))
    return tries.withColumn("failures", failures.cast("long")).withColumn("blocked", failures >= most)


def display_state(db: Column, sheet: Column, file_exists: Column, stale: Column) -> Column:
    """What a drawing's state is shown as, the first that holds."""
    return (
        F.when(db == "pending", "pending").when(sheet == "done", "done").when(sheet == "failed", "failed").when((db == "rendering") & ~F.coalesce(stale, F.lit(False)), "rendering").when(db == "failed", "failed").when(db.isNull() & file_exists, "stale").when(db.isNull(), F.lit(None)).otherwise("done")
    )


def reprocess_plan(files: DataFrame, cases: DataFrame) -> DataFrame:
    """All files of the asked cases, or none of a case that is busy."""
    asked = files.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    busy = asked.where(F.col("status").isin("processing", "reviewing")).select("case_id").distinct().withColumn("__busy", F.lit(True))
    return asked.join(busy, "case_id", "left").withColumn("action", F.when(F.col("__busy"), "abort").when(F.col("status") == "skipped", "keep").otherwise("requeue")).drop("__busy")


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Rows that can no longer be used: used, revoked or past their time."""
    return rows.where(F.col("used_at").isNotNull() | F.col("revoked_at").isNotNull() | (F.col("expires_at") <= now))
