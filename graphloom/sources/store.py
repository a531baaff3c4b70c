"""Graphs on disk: Parquet parts and one JSON manifest per commit, through Spark's file systems only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.errors import GraphNotFound


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name first; the rename publishes it whole. It fails if the file is there."""
    fs, target = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file, or a folder with all in it."""
    (fs, a), (ft, b) = _fs(spark, source), _fs(spark, target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, ft, b, False, conf):
        raise OSError(f"{source} could not be copied to {target}")


def write_part(df: DataFrame, folder: str) -> dict[str, str]:
    """Write rows as Parquet; what a manifest says of them."""
    path = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return {"path": path, "schema": schema.json()}


def read_part(spark: SparkSession, part: dict[str, str]) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(part["schema"]))).parquet(part["path"])


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of a graph's commits in order."""
    names = [n for n in children(spark, f"{folder}/commits") if n.endswith(".json")]
    if not names:
        raise GraphNotFound(f"there is no graph in {folder}")
    return [json.loads(read_text(spark, f"{folder}/commits/{n}")) for n in names]
