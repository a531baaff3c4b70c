"""Scans of a graph for programs: by label, by property, by the labels at an edge's ends, of whole nodes, and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import LABELS, PropertyGraph, quoted


def scan_nodes(graph: PropertyGraph, labels: Iterable[str] = ()) -> DataFrame:
    """(id) of the nodes that have all the labels."""
    return graph.scan_nodes(tuple(labels))


def scan_edges(graph: PropertyGraph, src_labels: Iterable[str] = (), dst_labels: Iterable[str] = ()) -> DataFrame:
    """(eid, src, dst, type) of each edge once, restricted by the labels at its ends."""
    src_labels, dst_labels = tuple(src_labels), tuple(dst_labels)
    graph.check_labels((*src_labels, *dst_labels))
    tables = [(t, "src") for t in graph.edges if (t.src_labels is None or set(src_labels) <= t.src_labels) and (t.dst_labels is None or set(dst_labels) <= t.dst_labels)]
    df = graph.scan_edges(tables, "e", "src", "dst", (), (), (":type",)).withColumnsRenamed({"e": "eid", "e.:type": "type"}).select("eid", "src", "dst", "type")
    for end, labels, known in (("src", src_labels, all(t.src_labels is not None for t, _ in tables)), ("dst", dst_labels, all(t.dst_labels is not None for t, _ in tables))):
        if labels and not known:
            df = df.join(graph.scan_nodes(labels, (), "labelled"), F.col(end) == F.col("labelled"), "left_semi")
    return df


def scan_node_property(graph: PropertyGraph, prop: str, labels: Iterable[str] = ()) -> DataFrame:
    """(id, value) of the nodes that have the property."""
    return graph.scan_nodes(tuple(labels), (prop,), "id").withColumnRenamed(f"id.{prop}", "value").where(F.col("value").isNotNull())


def scan_edge_property(graph: PropertyGraph, prop: str) -> DataFrame:
    """(eid, value) of the edges that have the property."""
    graph.property_type(prop)
    tables = [(t, "src") for t in graph.edges if prop in t.props]
    return graph.scan_edges(tables, "eid", "src", "dst", (), (prop,)).select("eid", quoted(f"eid.{prop}").alias("value")).where(F.col("value").isNotNull())


def properties_of(graph: PropertyGraph, nodes: DataFrame, prop: str, keep_missing: bool = False) -> DataFrame:
    """(id, value) for a DataFrame of ids; without keep_missing only where there is a value."""
    values = scan_node_property(graph, prop)
    return nodes.select("id").join(values, "id", "left" if keep_missing else "inner")


def edges_of(graph: PropertyGraph, nodes: DataFrame, direction: str = "out") -> DataFrame:
    """(id, eid, type, other) for a DataFrame of ids: out, in or both; a loop counts in both directions."""
    frames = graph.scan_edges(graph.edge_tables((), direction), "eid", "near", "other", (), (), (":type",)).withColumnRenamed("eid.:type", "type")
    return nodes.select("id").join(frames, F.col("id") == F.col("near")).select("id", "eid", "type", "other")


def node_views(graph: PropertyGraph, nodes: DataFrame) -> DataFrame:
    """(id, labels, out, in, properties) for a DataFrame of ids. A node's edges come in one row: meant for nodes that someone looks at."""
    own = graph.all_nodes().join(nodes.select("id").distinct(), "id", "left_semi")
    props = [c for c in own.columns if c not in ("id", "labels")]
    edge = F.struct("eid", "type", "other")
    out = edges_of(graph, nodes.distinct(), "out").groupBy("id").agg(F.collect_list(edge).alias("out"))
    back = edges_of(graph, nodes.distinct(), "in").groupBy("id").agg(F.collect_list(edge).alias("in"))
    return own.join(out, "id", "left").join(back, "id", "left").select("id", "labels", "out", "in", F.struct(*(quoted(p) for p in props)).alias("properties"))


def label_sets(graph: PropertyGraph, labels: Iterable[str] = ()) -> DataFrame:
    """(labels, nodes): each label set that holds the labels, and how many nodes have it."""
    return graph.scan_nodes(tuple(labels), (), "id", True).groupBy(F.array_sort(quoted(f"id.{LABELS}")).alias("labels")).agg(F.count(F.lit(1)).alias("nodes"))


def counts(graph: PropertyGraph) -> DataFrame:
    """(nodes, edges) that are live."""
    n = graph.scan_nodes().agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(scan_edges(graph).agg(F.count(F.lit(1)).alias("edges")))
