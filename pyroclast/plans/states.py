"""Queries of queues, quotas and limits in batch, and their streaming twins (§2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyroclast.operators import state
from pyroclast.plans.registry import query, table
from pyroclast.streaming import stateful, twins


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("done")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), status.alias("status"), (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@query("SELECT o_orderkey AS id, 'processing' AS status, o_orderkey % 4 + 1 AS attempts FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 5")
def queue_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest queued jobs, claimed by the one writer of a batch."""
    return state.claim(_jobs(spark, sf), 5).select("id", "status", "attempts")


@query("""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus <> 'P' THEN 'done' WHEN o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 3600 SECOND THEN 'processing' WHEN o_orderkey % 4 < 3 THEN 'queued' ELSE 'failed' END AS status FROM orders) GROUP BY 1
""")
def stale_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Leases that ran out."""
    return state.recover_stale(_jobs(spark, sf), F.lit("1998-01-01").cast("timestamp"), 3600).groupBy("status").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'pending' END AS state FROM orders
""")
def generation_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Results of an older generation are dropped."""
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(2).alias("gen"), F.lit("pending").alias("state"))
    results = jobs.select("id", F.explode(F.array(F.lit(1), F.when(F.col("id") % 3 == 0, 2))).alias("gen")).where("gen IS NOT NULL").withColumn("state", F.lit("done"))
    return state.apply_results(jobs, results).select("id", "state")


@query("""
    SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND value < 50
""")
def decision_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The latest decision of each key; a null one takes it back."""
    log = table(spark, sf, "events").withColumn("value", F.when(F.col("value") < 50, F.col("value")))
    return state.snapshot(log, ["user_id", "event_type"], F.desc("event_id"), "value").select("user_id", "event_type", "value")


@query("""
    WITH d AS (SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR + INTERVAL 1 MINUTE AS DATE) AS VARCHAR) AS day FROM events)
    SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY event_id) <= 100 AS accepted FROM d
""")
def business_day_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred requests of each business day."""
    return state.daily_quota(table(spark, sf, "events"), "ts", "event_id", 100).select("event_id", F.col("day").cast("string").alias("day"), "accepted")


_LOCKOUT = """
    SELECT event_id, user_id, failures, failures >= 3 AS blocked FROM (
        SELECT event_id, user_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failures FROM events)
"""


@query(_LOCKOUT)
def sliding_lockout(spark: SparkSession, sf: str) -> DataFrame:
    """Users with too many failures in the window before a try."""
    return state.sliding_lockout(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error", 3, 172_800).select("event_id", "user_id", "failures", "blocked")


@query(_LOCKOUT)
def sliding_lockout_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream with state by user."""
    return twins.run_available(twins.lockout(twins.parquet_stream(spark, sf, "events"), 3, 172_800))


@query("""
    SELECT day, event_type, count(*) AS n FROM (SELECT (ts + INTERVAL 481 MINUTE)::DATE AS day, event_type, max(ts) OVER () AS newest FROM events)
    WHERE day + INTERVAL 1 DAY - INTERVAL 481 MINUTE <= newest - INTERVAL 1 HOUR GROUP BY 1, 2
""")
def daily_counts_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events by business day and type as a windowed stream; days before the watermark are final."""
    return twins.run_available(twins.daily_counts(twins.parquet_stream(spark, sf, "events")))


@query("""
    SELECT id, case_id, action FROM (SELECT o_orderkey AS id, o_custkey AS case_id, CASE WHEN bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) THEN 'abort' ELSE 'requeue' END AS action FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
""")
def reprocess_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Cases are reprocessed as a whole or not at all."""
    cases = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    return state.reprocess_plan(_jobs(spark, sf), cases).select("id", "case_id", "action")


@query("""
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rendering' END WHEN 3 THEN 'failed' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'stale' END END AS shown FROM orders
""")
def display_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state that is shown, by precedence."""
    k = F.col("o_orderkey") % 5
    db = F.when(k == 0, "pending").when(k == 2, "rendering").when(k == 3, "failed")
    return table(spark, sf, "orders").select("o_orderkey", state.display_state(db, F.when(k == 1, "done"), F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F").alias("shown"))


@query("""
    WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ms, ts, event_id, max(ts) OVER () AS newest FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY id ORDER BY ts, event_id) <= 21600000 THEN 0 ELSE 1 END AS new FROM e))
    SELECT id, min(ms) AS start, max(ms) AS finish, count(*) AS n FROM (SELECT *, max(s) OVER (PARTITION BY id) AS latest FROM g) GROUP BY id, s HAVING max(ms) + 21600001 <= epoch_us(any_value(newest) - INTERVAL 1 HOUR) // 1000 OR s < any_value(latest)
""")
def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """users' sessions, apart by six hours; those that may go on are still open."""
    events = stateful.as_events(twins.parquet_stream(spark, sf, "events"), "user_id", F.lit("x"))
    return stateful.run_available(stateful.sessions(events, 21_600))


@query("""
    WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ms, ts, event_id, CASE WHEN event_type = 'click' THEN 'ask' ELSE 'result' END AS kind, (ts::DATE - DATE '2024-01-01') - CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 2 END AS gen FROM events WHERE event_type IN ('click', 'view', 'purchase')),
    s AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts, kind, event_id) AS s FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY id ORDER BY ts, kind, event_id) <= 432000000 THEN 0 ELSE 1 END AS new FROM e)),
    n AS (SELECT *, max(CASE WHEN kind = 'ask' THEN gen END) OVER (PARTITION BY id, s ORDER BY ts, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s)
    SELECT id, ms, gen::BIGINT AS gen FROM n WHERE kind = 'result' AND gen = newest
""")
def generation_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Results of today or yesterday count if a click of that day was the last; users unheard of for five days are forgotten."""
    told = twins.parquet_stream(spark, sf, "events").where("event_type IN ('click', 'view', 'purchase')")
    ask = F.col("event_type") == "click"
    gen = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) - F.when(ask, 0).otherwise(F.col("event_id") % 2)
    return stateful.run_available(stateful.generations(stateful.as_events(told, "user_id", F.when(ask, "ask").otherwise("result"), gen), 432_000))


@query()
def lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    """users' jobs, claimed by views and clicks and finished by purchases, with leases of a day."""
    kind = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "purchase", "finish")
    return stateful.run_available(stateful.leases(stateful.as_events(twins.parquet_stream(spark, sf, "events"), "user_id", kind), 86_400))
