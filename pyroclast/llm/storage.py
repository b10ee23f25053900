"""Tables written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyroclast.sources.shared import fresh


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read from the files, with its lineage cut.

    Lost executors cost nothing that was written; the rows are computed once
    however many plans read them.  Results are read lazily, so nothing is deleted
    here: the folder's owner empties it when the jobs that use it are done.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
