"""Steps of a program's own in a plan: a source, a transformation of Arrow batches, a sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def source(spark: SparkSession, batches: Callable[[int], Iterable[pa.RecordBatch]], schema: str, parts: int = 1) -> DataFrame:
    """Rows that a function makes for each part's number, on the executors."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for n in b.column(0).to_pylist():
                yield from batches(n)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def transform(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Each batch of rows through a function."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            yield function(b)

    return df.mapInArrow(run, schema)


def sink(df: DataFrame, function: Callable[[Iterator], None]) -> None:
    """Each partition's rows to a function on the executors. A task that is run again calls it again."""
    df.foreachPartition(function)
