"""What a graph browser asks: lists of labels, types and nodes, properties, neighbours and edges of some nodes, a page at a time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.access import edges_of
from graphloom.operators.graph import LABELS, TYPE, PropertyGraph, quoted

PAGE, EDGES_PER_TYPE = 1000, 10


def _ids(graph: PropertyGraph, ids: Iterable[int] | DataFrame) -> DataFrame:
    return ids.select("id") if isinstance(ids, DataFrame) else graph.spark.createDataFrame([(int(i),) for i in ids], "id long")


def _holds(column: str, part: str):
    """Does a text hold another, whatever their case?"""
    return F.contains(F.lower(quoted(column)), F.lit(part.lower()))


def list_labels(graph: PropertyGraph, current: Iterable[str] = ()) -> DataFrame:
    """(label, nodes): labels besides the current ones, and how many nodes have them with all current ones."""
    current = tuple(current)
    nodes = graph.scan_nodes(current, (), "n", True)
    found = nodes.select(F.explode(quoted(f"n.{LABELS}")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    names = graph.spark.createDataFrame([(x,) for x in graph.labels if x not in current], "label string")
    return names.join(found, "label", "left").select("label", F.coalesce("nodes", F.lit(0)).alias("nodes"))


def list_property_types(graph: PropertyGraph, ids: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """(property): all, or those that some of the nodes have."""
    if ids is None:
        return graph.spark.createDataFrame([(p,) for p in graph.properties], "property string")
    return node_properties(graph, ids).select("property").distinct()


def list_edge_types(graph: PropertyGraph, eids: Iterable[int] | None = None) -> DataFrame:
    """(type): all, or those of the edges."""
    if eids is None:
        return graph.spark.createDataFrame([(t,) for t in graph.types], "type string")
    return get_edges(graph, eids).select("type").distinct()


def list_nodes(graph: PropertyGraph, labels: Iterable[str] = (), properties: Mapping[str, str] | None = None, skip: int = 0, limit: int = PAGE) -> tuple[DataFrame, bool]:
    """A page of (id, labels) and whether it is the last. Unknown labels and properties are left out of account; properties: parts that their texts hold, whatever the case."""
    known = tuple(x for x in labels if x in graph.labels)
    wanted = {k: v for k, v in (properties or {}).items() if graph.properties.get(k) is not None and graph.properties[k].simpleString() == "string"}
    df = graph.scan_nodes(known, tuple(wanted), "id", True)
    for k, v in wanted.items():
        df = df.where(_holds(f"id.{k}", v))
    rows = df.select("id", quoted(f"id.{LABELS}").alias("labels")).orderBy("id").offset(skip)
    return rows.limit(limit), rows.limit(limit + 1).count() <= limit


def node_properties(graph: PropertyGraph, ids: Iterable[int] | DataFrame, properties: Iterable[str] | None = None) -> DataFrame:
    """(id, property, value as text): the values that the nodes have."""
    props = [p for p in (properties if properties is not None else graph.properties) if any(p in t.props for t in graph.nodes)]
    df = graph.scan_nodes((), props, "id").join(_ids(graph, ids).distinct(), "id", "left_semi")
    pairs = F.array(*(F.struct(F.lit(p).alias("property"), quoted(f"id.{p}").cast("string").alias("value")) for p in props))
    return df.select("id", F.explode(pairs).alias("x")).select("id", "x.property", "x.value").where("value is not null")


def neighbors(graph: PropertyGraph, ids: Iterable[int] | DataFrame, limit: int = PAGE) -> DataFrame:
    """(id, eid, type, other, out, reached_end): at most limit edges of each node, and whether these are all of them."""
    near = _ids(graph, ids).distinct()
    both = edges_of(graph, near, "out").withColumn("out", F.lit(True)).unionByName(edges_of(graph, near, "in").withColumn("out", F.lit(False)))
    w = Window.partitionBy("id").orderBy(F.desc("out"), "type", "other", "eid")
    ranked = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit + 1)
    return ranked.withColumn("reached_end", F.max("place").over(Window.partitionBy("id")) <= limit).where(F.col("place") <= limit).drop("place")


def get_nodes(graph: PropertyGraph, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Whole nodes."""
    return graph.all_nodes().join(_ids(graph, ids).distinct(), "id", "left_semi")


def get_edges(graph: PropertyGraph, eids: Iterable[int]) -> DataFrame:
    """Whole edges."""
    return graph.all_edges().join(graph.spark.createDataFrame([(int(i),) for i in eids], "eid long").distinct(), "eid", "left_semi")


def node_edges(graph: PropertyGraph, ids: Iterable[int] | DataFrame, limits: Mapping[str, int] | None = None, default_limit: int = EDGES_PER_TYPE) -> DataFrame:
    """(id, type, out, eid, other, total): at most so many edges of each node, type and direction, with their full number."""
    near = _ids(graph, ids).distinct()
    both = edges_of(graph, near, "out").withColumn("out", F.lit(True)).unionByName(edges_of(graph, near, "in").withColumn("out", F.lit(False)))
    most = F.lit(default_limit)
    for t, n in (limits or {}).items():
        most = F.when(F.col("type") == t, n).otherwise(most)
    group = Window.partitionBy("id", "type", "out")
    counted = both.withColumn("total", F.count(F.lit(1)).over(group)).withColumn("place", F.row_number().over(group.orderBy("other", "eid")))
    return counted.where(F.col("place") <= most).select("id", "type", "out", "eid", "other", "total")


def explore_node_edges(graph: PropertyGraph, node: int, labels: Iterable[str] = (), types: Iterable[str] = (), node_parts: Mapping[str, str] | None = None, edge_parts: Mapping[str, str] | None = None, exclude_in: bool = False, exclude_out: bool = False, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """(eid, type, other, out): a page of one node's edges, by the other node's labels and properties and the edge's type and properties."""
    labels, types = tuple(labels), tuple(types)
    graph.check_types(types)
    frames = []
    for out, end in ((True, "src"), (False, "dst")):
        if exclude_out if out else exclude_in:
            continue
        props = tuple(edge_parts or ())
        df = graph.scan_edges(graph.edge_tables(types, "out" if out else "in"), "eid", "near", "other", types, props, (TYPE,)).where(F.col("near") == node)
        for k, v in (edge_parts or {}).items():
            df = df.where(_holds(f"eid.{k}", v))
        frames.append(df.select("eid", quoted(f"eid.{TYPE}").alias("type"), "other", F.lit(out).alias("out")))
    if not frames:
        return graph.spark.createDataFrame([], "eid long, type string, other long, out boolean")
    df = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    if labels or node_parts:
        nodes = graph.scan_nodes(labels, tuple(node_parts or ()), "n")
        for k, v in (node_parts or {}).items():
            nodes = nodes.where(_holds(f"n.{k}", v))
        df = df.join(nodes.select("n"), F.col("other") == F.col("n"), "left_semi")
    return df.orderBy(F.desc("out"), "type", "other", "eid").offset(skip).limit(limit)
