"""A folder of JSON exports of another graph database: nodes, edges, and what types their properties have.

Each file holds {"results": [{"columns": [...], "data": [{"row": [...]}]}]}. Nodes have rows of (id, labels, properties), edges of
(source, target, type, properties) or with an id in front. Files may be cut in pieces: nodes_0.json, nodes_1.json and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ExecError
from graphloom.sources import store

_DATA = "results array<struct<columns:array<string>,data:array<struct<row:array<string>>>>>"


def _rows(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(columns, row) of all results, each cell as JSON text."""
    df = spark.read.schema(_DATA).json([f"{folder}/{n}" for n in names], multiLine=True)
    return df.select(F.explode("results").alias("r")).select(F.col("r.columns").alias("columns"), F.explode("r.data").alias("d")).select("columns", F.col("d.row").alias("row"))


_SPARK = {"Bool": "boolean", "Int64": "bigint", "Double": "double", "String": "string"}


def _typed(df: DataFrame, props: str) -> list[Column]:
    """A column for each property and type found. Names and types are found over all rows; there is a row of each."""
    found = df.select(F.explode(F.from_json(props, "map<string,string>")).alias("k", "v")).where("v is not null")
    number, whole = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", r"^-?\d+$"
    kind = F.when(F.col("v").isin("true", "false"), "Bool").when(F.regexp_like("v", F.lit(whole)), "Int64").when(F.regexp_like("v", F.lit(number)), "Double").otherwise("String")
    kinds = sorted((r["k"], r["kind"]) for r in found.select("k", kind.alias("kind")).distinct().collect())
    value = lambda k: F.from_json(props, "map<string,string>").getItem(k)
    tests = {"Bool": lambda c: c.isin("true", "false"), "Int64": lambda c: F.regexp_like(c, F.lit(whole)), "Double": lambda c: F.regexp_like(c, F.lit(number)) & ~F.regexp_like(c, F.lit(whole)), "String": lambda c: ~F.regexp_like(c, F.lit(number)) & ~c.isin("true", "false")}
    return [F.when(tests[t](value(k)), value(k).try_cast(_SPARK[t])).alias(f"{k} ({t})") for k, t in kinds]


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, properties) and edges (eid, src, dst, type, properties)."""
    names = store.children(spark, folder)
    nodes = [n for n in names if n.startswith("nodes") and n.endswith(".json")]
    edges = [n for n in names if n.startswith("edges") and n.endswith(".json")]
    if not nodes:
        raise ExecError(f"{folder} has no nodes*.json")
    n = _rows(spark, folder, nodes).select(F.col("row")[0].cast("long").alias("id"), F.from_json(F.col("row")[1], "array<string>").alias("labels"), F.col("row")[2].alias("props"))
    node_df = n.select("id", "labels", *_typed(n, "props"))
    if not edges:
        return node_df, spark.createDataFrame([], "eid long, src long, dst long, type string")
    e = _rows(spark, folder, edges).select(F.slice("row", F.size("row") - 3, 4).alias("row")).select(F.monotonically_increasing_id().alias("eid"), F.col("row")[0].cast("long").alias("src"), F.col("row")[1].cast("long").alias("dst"), F.col("row")[2].alias("type"), F.col("row")[3].alias("props"))
    return node_df, e.select("eid", "src", "dst", "type", *_typed(e, "props"))
