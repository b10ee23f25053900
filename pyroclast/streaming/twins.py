"""Streaming twins of queues, quotas and limits (§2.13).

Each takes a streaming DataFrame with an event time; state is kept by key and
ends by timers, so it stays bounded.  ``run_available`` drives a stream over what
there is and returns the written rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyroclast.functions.text import business_day
from pyroclast.sources.shared import fresh


def parquet_stream(spark: SparkSession, folder: str, name: str, ts: str = "ts") -> DataFrame:
    """A table of ``folder`` as a stream of files, with event time as a timestamp that watermarks accept."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    single = spark.read.parquet(path).inputFiles()[0].rpartition("/")[0].rpartition("/")[2] != f"{name}.parquet"
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write what is available as Parquet in the shared folder, exactly once, and read it."""
    spark = stream.sparkSession
    out = fresh(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each business day and type; days are windows that begin at 15:59 UTC."""
    day = F.window("ts", "1 day", "1 day", "15 hours 59 minutes")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(business_day(F.col("window.start")).alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user, apart by a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def lockout(tries: DataFrame, most: int, seconds: int, failed: str = "error", late: str = "10 minutes") -> DataFrame:
    """Tries of each user with the failures in the window before them.

    State is a user's failure times of the last ``seconds``, dropped when the
    window has passed without another try.
    """

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, last = [], 0
        for r in rows.itertuples():
            now = int(r.ts.value // 1000)
            times = [t for t in times if t >= now - seconds * 1_000_000]
            n = sum(t < now for t in times)
            out.append((r.event_id, key[0], n, n >= most))
            if r.event_type == failed:
                times.append(now)
            last = max(last, now)
        state.update((times,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "failures", "blocked"])

    return tries.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(each, "event_id long, user_id long, failures long, blocked boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def generations(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Results that belong to the generation that asked last; late results of older ones are dropped.

    ``events``: ts, id, kind (ask or result), gen, state.
    """

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "kind"]).itertuples():
            if r.kind == "ask":
                newest = max(newest, r.gen)
            elif r.gen == newest:
                out.append((key[0], r.gen, r.state))
        state.update((int(newest),))
        yield pd.DataFrame(out, columns=["id", "gen", "state"])

    return events.withWatermark("ts", late).groupBy("id").applyInPandasWithState(each, "id long, gen long, state string", "gen long", "append", GroupStateTimeout.NoTimeout)


def leases(events: DataFrame, seconds: int, max_attempts: int = 3, late: str = "1 minute") -> DataFrame:
    """Jobs whose lease ran out without a finish: queued again, or failed.

    ``events``: ts, id, kind (claim or finish).  A timer in event time ends a lease.
    """

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, until = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], int(attempts), "queued" if attempts < max_attempts else "failed"))
            state.update((int(attempts), 0))
        else:
            for r in pd.concat(list(batches)).sort_values(["ts", "kind"]).itertuples():
                now = int(r.ts.value // 1_000_000)
                if until and now > until:
                    out.append((key[0], int(attempts), "queued" if attempts < max_attempts else "failed"))
                    until = 0
                if r.kind == "claim":
                    attempts, until = attempts + 1, now + seconds * 1000
                else:
                    until = 0
            state.update((int(attempts), int(until)))
            if until:
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "attempts", "status"])

    return events.withWatermark("ts", late).groupBy("id").applyInPandasWithState(each, "id long, attempts long, status string", "attempts long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_log(stream: DataFrame, path: str, keys: list[str], order: str):
    """Keep the latest row of each key as versioned snapshots, one writer and one version a batch."""
    checkpoint = f"{path}/_state"

    def write(batch: DataFrame, version: int) -> None:
        from pyroclast.operators.relational import latest_per_key

        spark = batch.sparkSession
        rows = batch
        if version > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/version={version - 1}").unionByName(batch)
        latest_per_key(rows, keys, F.desc(order)).write.mode("overwrite").parquet(f"{path}/version={version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
