import numpy as np
import pytest

from pyroclast.operators import extension


def test_table_function_and_aggregate(spark):
    extension.register(spark)
    spark.createDataFrame([(1, 5.0), (1, 1.0), (1, None), (1, 9.5), (2, 3.0), (None, 2.0), (3, None)], "floor int, x double").createOrReplaceTempView("spots")
    got = {r.floor: (r.rows, r.wide) for r in spark.sql("SELECT * FROM gaps(TABLE(spots), 'x', 'wide')").collect()}
    assert got == {1: (3, 4.5), 2: (1, None), None: (1, None), 3: (0, None)}
    with pytest.raises(Exception, match="is wanted"):
        spark.sql("SELECT * FROM gaps(TABLE(spots), 'nothing', 'wide')").collect()
    values = np.random.default_rng(1).integers(0, 1000, 37).tolist()
    spark.createDataFrame([(1, float(v)) for v in values] + [(2, None), (3, 4.0)], "g int, v double").createOrReplaceTempView("values_of")
    got = {r.g: r.m for r in spark.sql("SELECT g, trimmed_mean(v) AS m FROM values_of GROUP BY g").collect()}
    assert got == {1: pytest.approx(np.mean(sorted(values)[3:-3])), 2: None, 3: 4.0}


def test_hooks(spark):
    extension.hook("twice")(lambda texts: np.array([[len(t), 2 * len(t)] for t in texts]))
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    assert {r.id: r.vector for r in extension.with_vectors(df, "t", "twice").collect()} == {1: [3.0, 6.0], 2: None, 3: [0.0, 0.0]}
    assert sum(extension.with_vectors(df, "t", "letters", "v").first().v) == 3
    with pytest.raises(ValueError, match="no hook is named x"):
        extension.with_vectors(df, "t", "x")
