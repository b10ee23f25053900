"""Stateful streams against plain loops over sorted rows, restarts from a checkpoint, and how much state is left."""

import datetime

import numpy as np
import pytest

from pyroclast.streaming import stateful, twins

START = datetime.datetime(2024, 1, 1)


def ms(seconds):
    return 1_704_067_200_000 + 1000 * seconds


def rows_of(seed, n=400):
    rng = np.random.default_rng(seed)
    kinds = ["claim", "claim", "finish"]
    return [(START + datetime.timedelta(seconds=int(t)), int(rng.integers(0, 12)), kinds[rng.integers(0, 3)], int(rng.integers(0, 4)), k) for k, t in enumerate(np.sort(rng.choice(20_000, n, replace=False)))]


def folder_of(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "ts timestamp, id long, kind string, gen long, ord long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/t.parquet")
    return twins.parquet_stream(spark, f"{tmp_path}/{name}", "t")


def plain_leases(rows, seconds, most, until_ms):
    out, state = [], {}
    for ts, key, kind, *_ in [*rows, *((None, k, "end", 0, 0) for k in {r[1] for r in rows})]:
        now = until_ms if ts is None else int((ts - START).total_seconds() * 1000) + ms(0)
        attempts, until, since = state.get(key, (0, 0, 0))
        if until and now > until:
            out.append((key, until, attempts, "queued" if attempts < most else "failed"))
            attempts, since, until = (attempts if attempts < most else 0), until, 0
        if not until and now > since + 10_000 * seconds:
            attempts = 0
        if kind == "claim":
            if until:
                out.append((key, now, attempts, "refused"))
            else:
                attempts, until, since = attempts + 1, now + 1000 * seconds, now
                out.append((key, now, attempts, "claimed"))
        elif kind == "finish" and until:
            out.append((key, now, attempts, "done"))
            attempts, until, since = 0, 0, 0
        state[key] = attempts, until, since
    return sorted(out)


@pytest.mark.parametrize("seconds", [40, 700])
def test_leases_and_a_restart(spark, tmp_path, seconds):
    rows = rows_of(seconds)
    last = int((rows[-1][0] - START).total_seconds())
    want = plain_leases(rows, seconds, 3, ms(last - 60))
    got = stateful.run_available(stateful.leases(folder_of(spark, tmp_path, "whole", rows), seconds))
    assert sorted(map(tuple, got.collect())) == want and {r[3] for r in want} >= {"claimed", "refused", "done", "queued"}
    # the same in two runs, the second from the first one's checkpoint
    stateful.run_available(stateful.leases(folder_of(spark, tmp_path, "parts", rows[:220]), seconds), f"{tmp_path}/out")
    again = stateful.run_available(stateful.leases(folder_of(spark, tmp_path, "parts", rows[220:]), seconds), f"{tmp_path}/out")
    assert sorted(map(tuple, again.collect())) == want


def test_sessions_and_generations(spark, tmp_path):
    rows = rows_of(3, 200)
    stream = folder_of(spark, tmp_path, "s", rows)
    last = ms(int((rows[-1][0] - START).total_seconds()))
    got = sorted(map(tuple, stateful.run_available(stateful.sessions(stream, 900, "1 second")).collect()))
    want, open_ = [], {}
    for ts, key, *_ in rows:
        now = ms(int((ts - START).total_seconds()))
        if key in open_ and now <= open_[key][1] + 900_000:
            open_[key] = (open_[key][0], now, open_[key][2] + 1)
        else:
            want += [(key, *open_[key])] if key in open_ else []
            open_[key] = (now, now, 1)
    want += [(k, *s) for k, s in open_.items() if s[1] + 900_001 <= last - 1000]
    assert got == sorted(want)
    asked = [(ts, key, "ask" if kind == "finish" else "result", gen, n) for ts, key, kind, gen, n in rows]
    got = sorted(map(tuple, stateful.run_available(stateful.generations(folder_of(spark, tmp_path, "g", asked), 600)).collect()))
    want, newest = [], {}
    for ts, key, kind, gen, _ in asked:
        now = ms(int((ts - START).total_seconds()))
        asked_last, heard = newest.get(key, (None, 0))
        if now > heard + 600_000:
            asked_last = None
        if kind == "result" and asked_last == gen:
            want.append((key, now, gen))
        if kind == "ask":
            asked_last = gen if asked_last is None else max(asked_last, gen)
        newest[key] = asked_last, now
    assert got == sorted(want) and want


def test_state_ends(spark, tmp_path):
    """Of many keys that nothing is heard of any more none is left in the state."""
    rows = [(START + datetime.timedelta(seconds=k), k, "ask", 1, k) for k in range(300)] + [(START + datetime.timedelta(days=2), 999, "ask", 1, 999)]
    stream = stateful.generations(folder_of(spark, tmp_path, "e", rows), 60)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKS)
    try:
        q = stream.writeStream.outputMode("append").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(stateful.PROVIDER)
    assert max(kept) >= 300 and kept[-1] <= 5
