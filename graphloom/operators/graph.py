"""A property graph over DataFrames.

Nodes and edges live in tables. A table either has one label set (or edge type) for all its rows, which lets queries leave whole
tables unread, or carries it in a column. An edge table made from a foreign key may name the node table whose rows hold the key: an
expansion that ends at that table then reads edge and node from the same row instead of joining the table with itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import AnalyzeError

LABELS, TYPE, FROM, TO = ":labels", ":type", ":from", ":to"
ID_BITS = 48


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


Source = DataFrame | Callable[[], DataFrame]


@dataclass
class NodeTable:
    """source: id, property columns and, if labels is None, labels (array of strings), or a function that makes them when they are first read; kinds: the properties' types, where they are known before."""

    source: Source
    labels: frozenset[str] | None = None
    kinds: dict[str, T.DataType] | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @cached_property
    def props(self) -> dict[str, T.DataType]:
        return self.kinds if self.kinds is not None else {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("id", "labels")}


@dataclass
class EdgeTable:
    """source: eid, src, dst, property columns and, if type is None, type, or a function that makes them. held: the end ("src" or "dst") whose node table has the same rows, with carrier: source and that table's properties as node.<name>."""

    source: Source
    type: str | None = None
    src_labels: frozenset[str] | None = None
    dst_labels: frozenset[str] | None = None
    held: str | None = None
    carrier: Source | None = None
    kinds: dict[str, T.DataType] | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @cached_property
    def carried(self) -> DataFrame:
        return self.carrier() if callable(self.carrier) else self.carrier

    @cached_property
    def props(self) -> dict[str, T.DataType]:
        return self.kinds if self.kinds is not None else {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("eid", "src", "dst", "type")}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@dataclass
class PropertyGraph:
    """labels and types: all names that the graph knows, with or without rows."""

    spark: SparkSession
    nodes: list[NodeTable]
    edges: list[EdgeTable]
    labels: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    properties: dict[str, T.DataType] = field(default_factory=dict)

    def __post_init__(self):
        for t in self.nodes:
            self.labels += sorted(x for x in t.labels or () if x not in self.labels)
        for t in self.edges:
            if t.type is not None and t.type not in self.types:
                self.types.append(t.type)
        for t in (*self.nodes, *self.edges):
            for name, kind in t.props.items():
                self.properties.setdefault(name, kind)

    def check_labels(self, labels) -> None:
        for x in labels:
            if x not in self.labels:
                raise AnalyzeError(f"unknown label: {x}")

    def check_types(self, types) -> None:
        for x in types:
            if x not in self.types:
                raise AnalyzeError(f"unknown edge type: {x}")

    def property_type(self, name: str) -> T.DataType:
        if name not in self.properties:
            raise AnalyzeError(f"unknown property: {name}")
        return self.properties[name]

    def _value(self, table: NodeTable | EdgeTable, prop: str, prefix: str = "") -> Column:
        kind = self.property_type(prop)
        return quoted(prefix + prop).cast(kind) if prop in table.props else F.lit(None).cast(kind)

    def node_tables(self, labels=()) -> list[NodeTable]:
        return [t for t in self.nodes if t.labels is None or set(labels) <= t.labels]

    def scan_nodes(self, labels=(), props=(), name: str = "id", with_labels: bool = False) -> DataFrame:
        """Nodes that have all the labels: id as name, properties as name.prop, label arrays as name.:labels. Only what is asked for is read."""
        self.check_labels(labels)
        frames = []
        for t in self.node_tables(labels):
            df = t.df
            if t.labels is None:
                for x in labels:
                    df = df.where(F.array_contains("labels", x))
            columns = [F.col("id").cast("long").alias(name)] + [self._value(t, p).alias(f"{name}.{p}") for p in props]
            if with_labels:
                columns.append((F.col("labels") if t.labels is None else F.array(*(F.lit(x) for x in sorted(t.labels)))).alias(f"{name}.{LABELS}"))
            frames.append(df.select(columns))
        if not frames:
            fields = [T.StructField(name, T.LongType())] + [T.StructField(f"{name}.{p}", self.property_type(p)) for p in props]
            if with_labels:
                fields.append(T.StructField(f"{name}.{LABELS}", T.ArrayType(T.StringType())))
            return self.spark.createDataFrame([], T.StructType(fields))
        return _union(frames)

    def edge_tables(self, types=(), direction: str = "out", near=None, far=()) -> list[tuple[EdgeTable, str]]:
        """(table, near end) pairs that an expansion can use. near: the one label set of the near node, if known; far: labels wanted at the far node."""
        out = []
        for end in ("src", "dst") if direction == "both" else ("src",) if direction == "out" else ("dst",):
            for t in self.edges:
                here, there = (t.src_labels, t.dst_labels) if end == "src" else (t.dst_labels, t.src_labels)
                if types and t.type is not None and t.type not in types:
                    continue
                if near is not None and here is not None and here != near or there is not None and not set(far) <= there:
                    continue
                out.append((t, end))
        return out

    def scan_edges(self, tables: list[tuple[EdgeTable, str]], name: str, near: str, far: str, types=(), props=(), extra=(), carried=None) -> DataFrame:
        """Edges as near, far, name and properties name.prop. extra: of TYPE, FROM and TO; carried: (node name, its properties) taken from the same rows."""
        frames = []
        for t, end in tables:
            df = t.df if carried is None else t.carried
            if t.type is None and types:
                df = df.where(F.col("type").isin(list(types)))
            ends = (F.col("src"), F.col("dst")) if end == "src" else (F.col("dst"), F.col("src"))
            columns = [ends[0].cast("long").alias(near), ends[1].cast("long").alias(far), F.col("eid").cast("long").alias(name)]
            columns += [self._value(t, p).alias(f"{name}.{p}") for p in props]
            if TYPE in extra:
                columns.append((F.col("type") if t.type is None else F.lit(t.type)).alias(f"{name}.{TYPE}"))
            if FROM in extra:
                columns.append(F.col("src").cast("long").alias(f"{name}.{FROM}"))
            if TO in extra:
                columns.append(F.col("dst").cast("long").alias(f"{name}.{TO}"))
            if carried is not None:
                columns += [quoted(f"node.{p}").cast(self.property_type(p)).alias(f"{carried[0]}.{p}") if f"node.{p}" in df.columns else F.lit(None).cast(self.property_type(p)).alias(f"{carried[0]}.{p}") for p in carried[1]]
            frames.append(df.select(columns))
        if not frames:
            kinds = [(near, T.LongType()), (far, T.LongType()), (name, T.LongType())] + [(f"{name}.{p}", self.property_type(p)) for p in props]
            kinds += [(f"{name}.{TYPE}", T.StringType())] * (TYPE in extra) + [(f"{name}.{FROM}", T.LongType())] * (FROM in extra) + [(f"{name}.{TO}", T.LongType())] * (TO in extra)
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in kinds]))
        return _union(frames)

    def all_nodes(self) -> DataFrame:
        """id, labels and every property."""
        df = self.scan_nodes((), [p for p in self.properties if any(p in t.props for t in self.nodes)], "n", True)
        return df.toDF(*("id" if c == "n" else "labels" if c == f"n.{LABELS}" else c[2:] for c in df.columns))

    def all_edges(self) -> DataFrame:
        """eid, src, dst, type and every property."""
        props = [p for p in self.properties if any(p in t.props for t in self.edges)]
        df = self.scan_edges([(t, "src") for t in self.edges], "e", "src", "dst", (), props, (TYPE,))
        return df.toDF(*("eid" if c == "e" else "type" if c == f"e.{TYPE}" else c[2:] if c.startswith("e.") else c for c in df.columns))
