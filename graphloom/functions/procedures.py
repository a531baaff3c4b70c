"""Procedures: table functions of a graph. Each takes (graph, context, arguments) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.errors import AnalyzeError

Procedure = Callable[..., DataFrame]
_REGISTRY: dict[str, tuple[Procedure, str]] = {}


def register(name: str, signature: str):
    """Make a procedure known to queries; signature: column :: TYPE, ..."""

    def keep(function: Procedure) -> Procedure:
        _REGISTRY[name] = (function, f"{name}() :: ({signature})")
        return function

    return keep


def procedure(name: str) -> Procedure:
    if name not in _REGISTRY:
        raise AnalyzeError(f"unknown procedure: {name}")
    return _REGISTRY[name][0]


def value_type(t: T.DataType) -> str:
    """The storage type's name in the graph's own terms."""
    if isinstance(t, T.DecimalType):
        return "UInt64"
    for cls, name in ((T.IntegralType, "Int64"), (T.FractionalType, "Double"), (T.StringType, "String"), (T.BooleanType, "Bool")):
        if isinstance(t, cls):
            return name
    return t.simpleString()


@register("db.labels", "id :: INTEGER, label :: STRING")
def labels(graph, context) -> DataFrame:
    return graph.spark.createDataFrame(list(enumerate(graph.labels)), "id long, label string")


@register("db.edgeTypes", "id :: INTEGER, edgeType :: STRING")
def edge_types(graph, context) -> DataFrame:
    return graph.spark.createDataFrame(list(enumerate(graph.types)), "id long, edgeType string")


@register("db.propertyTypes", "id :: INTEGER, propertyType :: STRING, valueType :: STRING")
def property_types(graph, context) -> DataFrame:
    rows = [(k, n, value_type(t)) for k, (n, t) in enumerate(graph.properties.items())]
    return graph.spark.createDataFrame(rows, "id long, propertyType string, valueType string")


@register("db.history", "commit :: STRING, nodeCount :: INTEGER, edgeCount :: INTEGER, partCount :: INTEGER")
def history(graph, context) -> DataFrame:
    """Commits, latest last; the counts are those of the nodes and edges ever allocated."""
    rows = context.history() if context is not None else []
    return graph.spark.createDataFrame(rows, "commit string, nodeCount long, edgeCount long, partCount long")


@register("db.procedures", "name :: STRING, signature :: STRING")
def procedures(graph, context) -> DataFrame:
    return graph.spark.createDataFrame([(n, s) for n, (_, s) in _REGISTRY.items()], "name string, signature string")
