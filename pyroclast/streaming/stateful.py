"""Keyed state with timers: leases, generations and sessions as stateful processors (§2.13: M01 to M03, M15).

Each key's state is one small row and a timer in event time, and both go when the timer fires: a lease that ran out, a
key that nothing was heard of for ``keep`` seconds, a session that is over.  So the state is as large as
what is open now, not as what has ever been seen.  Rows of a key are taken in order of time within a
micro-batch; rows behind the watermark are dropped, which a restart from the checkpoint doesn't change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pyroclast.sources.shared import fresh

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The generation before any was asked for.
NEVER = -(2**62)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """A step takes (state, key, row) and a timer step (state, key, now); both give the new state (None: forget), when to wake (ms) and rows."""

    def __init__(self, schema: str, columns: list[str], step: Callable, wake: Callable) -> None:
        self.schema, self.columns, self.step, self.wake = schema, columns, step, wake

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def _keep(self, state: tuple | None, until: int | None, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(max(int(until), now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, until, out = (tuple(self.state.get()) if self.state.exists() else None), 0, []
        told = pd.concat(list(rows))
        told = told.assign(at=told["ts"].astype("datetime64[us]").astype("int64") // 1000)
        for r in told.sort_values([c for c in ("ts", "kind", "ord") if c in told]).itertuples():
            state, until, found = self.step(state, key[0], r)
            out += found
        self._keep(state, until, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else None
        state, until, out = self.wake(state, key[0], expiredTimerInfo.getExpiryTimeInMs())
        self._keep(state, until, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _transformed(events: DataFrame, late: str, machine: Machine, schema: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(machine, schema, "append", "eventTime")


def leases(events: DataFrame, seconds: int, most: int = 3, late: str = "1 minute") -> DataFrame:
    """Jobs by claim and finish (M01, M02): id, ms, attempts and what happened: claimed, refused, done, queued or failed.

    ``events``: ts, id, kind (claim or finish).  A claim is refused while another's lease runs.  A lease that runs out
    queues the job again, or fails it after ``most`` attempts; a finish after that changes nothing.  A queued
    job's attempts are kept for as long as ten leases, then it counts as new.
    """
    span = seconds * 1000

    def out_of_time(attempts: int, key, at: int) -> tuple:
        rows = [(key, at, attempts, "queued" if attempts < most else "failed")]
        return ((attempts, 0, at) if attempts < most else None), at + 10 * span, rows

    def step(state, key, r):
        attempts, until, since = state or (0, 0, 0)
        out, now = [], int(r.at)
        if until and now > until:
            state, _, out = out_of_time(attempts, key, until)
            attempts, until, since = state or (0, 0, 0)
        if not until and attempts and now > since + 10 * span:
            attempts = 0
        if r.kind == "claim":
            if until:
                return (attempts, until, since), until, [*out, (key, now, attempts, "refused")]
            attempts, until = attempts + 1, now + span
            return (attempts, until, now), until, [*out, (key, now, attempts, "claimed")]
        if until:
            return None, 0, [*out, (key, now, attempts, "done")]
        return ((attempts, 0, since) if attempts else None), since + 10 * span, out

    def wake(state, key, now):
        if state is None or not state[1]:
            return None, 0, []
        return out_of_time(state[0], key, state[1])

    return _transformed(events, late, Machine("attempts long, until long, since long", ["id", "ms", "attempts", "status"], step, wake), "id long, ms long, attempts long, status string")


def generations(events: DataFrame, keep: int, late: str = "10 minutes") -> DataFrame:
    """Results of the generation that asked last (M03): id, ms, gen; others are dropped.

    ``events``: ts, id, kind (ask or result), gen.  A key that nothing was heard of for ``keep`` seconds is forgotten.
    """
    span = keep * 1000

    def step(state, key, r):
        newest, heard = state or (NEVER, 0)
        now = int(r.at)
        if state and now > heard + span:
            newest = NEVER
        out = [(key, now, int(r.gen))] if r.kind == "result" and r.gen == newest else []
        newest = max(newest, int(r.gen)) if r.kind == "ask" else newest
        return (newest, now), now + span, out

    return _transformed(events, late, Machine("newest long, heard long", ["id", "ms", "gen"], step, lambda state, key, now: (None, 0, [])), "id long, ms long, gen long")


def sessions(events: DataFrame, gap: int, late: str = "1 hour") -> DataFrame:
    """Sessions of a key, apart by more than ``gap`` seconds (M15): id, start and finish (ms), n. A session comes out when it is over."""
    span = gap * 1000

    def step(state, key, r):
        now, out = int(r.at), []
        if state and now > state[1] + span:
            out, state = [(key, *state)], None
        start, _, n = state or (now, now, 0)
        return (start, now, n + 1), now + span + 1, out

    def wake(state, key, now):
        return None, 0, [(key, *state)] if state else []

    return _transformed(events, late, Machine("start long, finish long, n long", ["id", "start", "finish", "n"], step, wake), "id long, start long, finish long, n long")


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Take in what is available, exactly once, and read all rows written so far; a ``folder`` given again goes on from its checkpoint."""
    spark = stream.sparkSession
    out, before = folder or fresh(spark, "stateful"), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def as_events(stream: DataFrame, key: str, kind, gen=None) -> DataFrame:
    """ts, id, kind, gen and ord of a table's rows; rows without a time or a key, or of no kind, are left out."""
    told = stream.select("ts", F.col(key).cast("long").alias("id"), kind.alias("kind"), (F.lit(0) if gen is None else gen).cast("long").alias("gen"), F.col("event_id").alias("ord"))
    return told.where("ts IS NOT NULL AND id IS NOT NULL AND kind IS NOT NULL")
