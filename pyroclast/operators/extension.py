"""What a user adds: table functions that declare their columns, aggregates over Arrow arrays, and hooks chosen when a plan is made (§2.14: N01, N05).

``register`` makes the functions known to a session's SQL under their names; a rule of one's own is called as
``SELECT * FROM gaps(TABLE(devices), 'x', 'gap')``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Gaps:
    """For each floor the widest gap between neighbours along a column, and how many rows it has.

    The call names the column to go along and the column to make; rows are partitioned by ``floor`` and
    ordered by Spark, so a floor passes through one row at a time and nothing of it is kept but two numbers.  Nulls are passed over.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, along: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        columns = {f.name: f.dataType for f in rows.dataType.fields} if rows.isTable else {}
        if "floor" not in columns or along.value not in columns:
            raise ValueError(f"gaps: a table with floor and {along.value} is wanted")
        schema = StructType().add("floor", columns["floor"]).add("rows", LongType()).add(name.value, DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("floor")], orderBy=[OrderingColumn(along.value)])

    def __init__(self) -> None:
        self.floor, self.rows, self.last, self.widest = None, 0, None, None

    def eval(self, row, along: str, name: str) -> None:  # noqa: ARG002
        self.floor, value = row["floor"], row[along]
        if value is None:
            return
        if self.last is not None:
            self.widest = max(self.widest or 0.0, float(value) - self.last)
        self.rows, self.last = self.rows + 1, float(value)

    def terminate(self) -> Iterator[tuple]:
        yield self.floor, self.rows, self.widest


gaps = udtf(Gaps)


def trimmed_mean(values: pa.Array) -> float:
    """Mean without the least and the greatest tenth (rounded down) of a group's values; null without values. A group is one floor's."""
    x = np.sort(values.drop_null().to_numpy(zero_copy_only=False).astype(float))
    k = len(x) // 10
    return float(x[k : len(x) - k].mean()) if len(x) else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("gaps", gaps)
    spark.udf.register("trimmed_mean", arrow_udf(trimmed_mean, DoubleType()))


#: Hooks by name: each takes a batch of texts and gives one vector for each; a plan names the one that it wants.
HOOKS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def hook(name: str) -> Callable:
    def add(f: Callable[[list[str]], np.ndarray]) -> Callable:
        HOOKS[name] = f
        return f

    return add


@hook("letters")
def letters(texts: list[str]) -> np.ndarray:
    """Counts of a to z."""
    out = np.zeros((len(texts), 26))
    for k, t in enumerate(texts):
        b = np.frombuffer(t.encode("ascii", "ignore").lower(), np.uint8)
        out[k] = np.bincount(b[(b >= 97) & (b <= 122)] - 97, minlength=26)
    return out


def with_vectors(nodes: DataFrame, text: str, name: str, column: str = "vector") -> DataFrame:
    """``nodes`` with a vector by the hook of this name, a batch at a time; an unknown name fails before anything runs, a null text has no vector."""
    if name not in HOOKS:
        raise ValueError(f"no hook is named {name}; there are {', '.join(sorted(HOOKS))}")
    embed, kinds = HOOKS[name], StructType([*nodes.schema.fields]).add(column, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(nodes_text).to_pylist()
            some = [k for k, t in enumerate(told) if t is not None]
            made: list = [None] * len(told)
            if some:
                for k, v in zip(some, embed([told[k] for k in some]).tolist(), strict=True):
                    made[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, column])

    nodes_text = nodes.columns.index(text)
    return nodes.mapInArrow(run, kinds)
