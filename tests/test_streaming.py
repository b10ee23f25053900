import datetime

from pyroclast.streaming import twins


def _stream(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in/t.parquet")
    return twins.parquet_stream(spark, f"{tmp_path}/in", "t")


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_generations(spark, tmp_path):
    rows = [(at(0), 1, "ask", 1, None), (at(1), 1, "ask", 2, None), (at(2), 1, "result", 1, "old"), (at(3), 1, "result", 2, "new")]
    stream = _stream(spark, tmp_path, rows, "ts timestamp, id long, kind string, gen long, state string")
    assert [tuple(r) for r in twins.run_available(twins.generations(stream)).collect()] == [(1, 2, "new")]


def test_leases(spark, tmp_path):
    rows = [(at(0), 1, "claim"), (at(500), 1, "claim"), (at(510), 1, "finish"), (at(0), 2, "claim"), (at(5), 2, "finish")]
    stream = _stream(spark, tmp_path, rows, "ts timestamp, id long, kind string")
    assert [tuple(r) for r in twins.run_available(twins.leases(stream, 100)).collect()] == [(1, 1, "queued")]


def test_sessions_and_log(spark, tmp_path):
    rows = [(at(0), 1, 1), (at(60), 1, 2), (at(7200), 1, 3), (at(400000), 2, 4)]
    stream = _stream(spark, tmp_path, rows, "ts timestamp, user_id long, v long")
    got = sorted((r.user_id, r.n) for r in twins.run_available(twins.sessions(stream)).collect())
    assert got[:2] == [(1, 1), (1, 2)]
    out = f"{tmp_path}/log"
    twins.upsert_log(stream, out, ["user_id"], "ts").start().awaitTermination()
    assert sorted((r.user_id, r.v) for r in spark.read.parquet(f"{out}/version=0").select("user_id", "v").collect()) == [(1, 3), (2, 4)]
