"""Every query runs at the smallest scale and gives the rows of its SQL."""

import pytest

from pyroclast.plans.catalogue import ORACLES, QUERIES
from tests.oracle import FOLDER, connect, rows


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        want = connect().execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
