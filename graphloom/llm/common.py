"""Helpers that the training-data operators share: reading tables, tables written between steps, digests."""

from __future__ import annotations

import atexit
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch of texts, so that it stays within a worker's memory; a longer text is a batch of its own.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1000, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the Arrow batches that Python workers read; the same for all operators, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of texts, one after another, and the bounds of each; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of at most TEXT_BATCH_ROWS and that many bytes of text; a longer text stands alone."""
    for b in batches:
        _, bounds = text_bytes(b.column(column))
        at = 0
        while at < b.num_rows:
            end = min(max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1), at + TEXT_BATCH_ROWS)
            yield b.slice(at, end - at)
            at = end


def lean(run: Callable) -> Callable:
    """run, a function of mapInArrow, and then the worker's free memory back to the system: an idle worker stands beside the executor's heap."""

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return lean_run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset (as in tests)."""
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")


def _remove(sc, path: str) -> None:
    if sc._jsc is None:
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is then the cluster's to clean
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark.sparkContext, path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads again."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(table.sparkSession.sparkContext, path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged tables that nothing reads again, and let Spark drop the shuffles of finished steps."""
    remove(*tables)
    for _ in range(2):  # the end of a job is told to listeners, which hold on to it meanwhile
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


def joined_digest(items) -> F.Column:
    """Lower-case hex SHA-256 of a comma-joined array of strings."""
    return F.sha2(F.array_join(items, ","), 256)


def let(value: F.Column, body) -> F.Column:
    """body(value) with value computed once: the optimiser would copy a column into the lambdas that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
