"""A property graph over relational tables in Parquet, without a copy.

A node's identity is its label's number above its key's bits. Edges come straight from foreign keys, whose tables carry the nodes that
hold the key. An edge's identity comes from its keys alone, so it is the same in every scan, however the rows are dealt: its source's number
above the keys' bits, or, where they don't fit, a negative number from a 63-bit hash of them (two of n such edges share one with a chance of about
n * n / 2 ** 64). Rows with equal keys share an identity.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType, StructType

from graphloom.operators.graph import ID_BITS, EdgeTable, NodeTable, PropertyGraph, quoted
from graphloom.sources import store


#: Bits of an edge's keys in its identity, below the number of its source.
EDGE_BITS = 56


@dataclass(frozen=True)
class NodeSource:
    """label, table and key column; distinct: the table repeats its keys and has no properties for them."""

    label: str
    table: str
    key: str
    distinct: bool = False


@dataclass(frozen=True)
class EdgeSource:
    """type, table, (label, column) of both ends, property columns; held: the end whose node table this is; distinct: pairs once.

    keys: the columns that tell apart edges that no node's table holds and that aren't distinct; by default both ends and all properties.
    """

    type: str
    table: str
    src: tuple[str, str]
    dst: tuple[str, str]
    props: tuple[str, ...] = ()
    held: str | None = None
    distinct: bool = False
    keys: tuple[str, ...] = ()

    def identity(self) -> tuple[tuple[str, int], ...]:
        if self.held:
            return (((self.src if self.held == "src" else self.dst)[1], EDGE_BITS),)
        if self.distinct:
            return ((self.src[1], EDGE_BITS // 2), (self.dst[1], EDGE_BITS // 2))
        return tuple((name, 0) for name in self.keys or (self.src[1], self.dst[1], *self.props))


NODES = (
    NodeSource("Region", "region", "r_regionkey"),
    NodeSource("Nation", "nation", "n_nationkey"),
    NodeSource("Customer", "customer", "c_custkey"),
    NodeSource("Supplier", "supplier", "s_suppkey"),
    NodeSource("Part", "part", "p_partkey"),
    NodeSource("Order", "orders", "o_orderkey"),
    NodeSource("User", "events", "user_id", distinct=True),
    NodeSource("Event", "events", "event_id"),
    NodeSource("Document", "documents", "doc_id"),
    NodeSource("Page", "pages", "page_id"),
    NodeSource("Item", "benchmark", "item_id"),
)
_LINE = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
EDGES = (
    EdgeSource("IN_REGION", "nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), held="src"),
    EdgeSource("IN_NATION", "customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), held="src"),
    EdgeSource("IN_NATION", "supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), held="src"),
    EdgeSource("PLACED", "orders", ("Customer", "o_custkey"), ("Order", "o_orderkey"), held="dst"),
    EdgeSource("CONTAINS", "lineitem", ("Order", "l_orderkey"), ("Part", "l_partkey"), _LINE, keys=("l_orderkey", "l_partkey", "l_suppkey", *_LINE)),
    EdgeSource("SUPPLIED_BY", "lineitem", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), distinct=True),
    EdgeSource("DID", "events", ("User", "user_id"), ("Event", "event_id"), held="dst"),
)


def node_id(ordinal: int, key: str) -> Column:
    return F.lit(ordinal << ID_BITS).bitwiseOR(quoted(key).cast("long"))


def edge_id(number: int, keys: tuple[tuple[str, int], ...]) -> Column:
    """The identity of an edge by its keys: packed where all fit the bits given for them (0: never), or a negative hash."""
    hashed = F.xxhash64(F.lit(number), *(quoted(name) for name, _ in keys)).bitwiseOR(F.lit(-(2**63)))
    if not all(bits for _, bits in keys):
        return hashed
    packed, fits = F.lit(number).cast("long"), F.lit(True)
    for name, bits in keys:
        c = quoted(name).cast("long")
        packed, fits = F.shiftleft(packed, bits).bitwiseOR(c), fits & (c >= 0) & (c < 1 << bits)
    return F.when(fits, packed).otherwise(hashed)


def _property(df: DataFrame, name: str) -> Column:
    """Whole numbers are long in the graph."""
    c = quoted(name)
    return (c.cast("long") if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int") else c).alias(name)


#: Schemas of tables that were read before, by session, path and time of change: finding one out takes a job.
_SCHEMAS: dict[tuple[str, str, int], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, whose schema is read once for as long as the table isn't changed."""
    key = (spark.sparkContext.applicationId, path, store.modified(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def table_graph(spark: SparkSession, folder: str, nodes=NODES, edges=EDGES, extras: dict[str, DataFrame] | None = None) -> PropertyGraph:
    """The graph of the tables in a folder. extras: tables to use in place of the folder's."""
    read: dict[str, DataFrame] = dict(extras or {})

    def table(name: str) -> DataFrame:
        if name not in read:
            read[name] = read_table(spark, f"{folder}/{name}.parquet")
        return read[name]

    ordinal = {n.label: k for k, n in enumerate(nodes)}

    def kinds(name: str, columns) -> dict[str, DataType]:
        schema = table(name).schema
        return {c: LongType() if isinstance(schema[c].dataType, IntegralType) else schema[c].dataType for c in columns}

    def node_rows(n: NodeSource) -> DataFrame:
        df = table(n.table)
        if n.distinct:
            return df.select(node_id(ordinal[n.label], n.key).alias("id"), _property(df, n.key)).where("id is not null").distinct()
        return df.where(quoted(n.key).isNotNull()).select(node_id(ordinal[n.label], n.key).alias("id"), *(_property(df, c) for c in df.columns))

    def edge_rows(number: int, e: EdgeSource, carry: bool) -> DataFrame:
        df = table(e.table).where(quoted(e.src[1]).isNotNull() & quoted(e.dst[1]).isNotNull())
        ends = [node_id(ordinal[e.src[0]], e.src[1]).alias("src"), node_id(ordinal[e.dst[0]], e.dst[1]).alias("dst")]
        # an edge's identity is read only where a query asks for it
        eid = edge_id(number, e.identity()).alias("eid")
        if e.distinct:
            return df.select(quoted(e.src[1]), quoted(e.dst[1])).distinct().select(eid, *ends)
        held = [_property(df, c).alias(f"node.{c}") for c in df.columns] if carry else []
        return df.select(eid, *ends, *(_property(df, p) for p in e.props), *held)

    node_tables = [NodeTable(partial(node_rows, n), frozenset({n.label}), kinds(n.table, [n.key] if n.distinct else table(n.table).columns)) for n in nodes]
    edge_tables = [
        EdgeTable(partial(edge_rows, k, e, False), e.type, frozenset({e.src[0]}), frozenset({e.dst[0]}), e.held, partial(edge_rows, k, e, True) if e.held else None, kinds(e.table, e.props))
        for k, e in enumerate(edges)
    ]
    return PropertyGraph(spark, node_tables, edge_tables)
