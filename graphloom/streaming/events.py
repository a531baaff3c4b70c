"""Structured Streaming over event tables: windowed counts with late rows held off, and edges appended to a graph batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.versions import VersionedGraph


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, in the order in which they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, time_col: str) -> DataFrame:
    """Event times as points in time: watermarks don't take times without a zone."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, *, time_col: str = "ts", key_col: str = "event_type", value_col: str = "value", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, key, events, total) of tumbling or sliding windows; rows later than late after the newest are dropped."""
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    counted = _timed(events, time_col).withWatermark(time_col, late).groupBy(span.alias("w"), key_col).agg(F.count(F.lit(1)).alias("events"), F.sum(value_col).alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col(key_col).alias("key"), "events", "total")


def sessions(events: DataFrame, *, time_col: str = "ts", user_col: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, user, events) of each user's sessions, which a gap ends."""
    counted = _timed(events, time_col).withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), user_col).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col(user_col).alias("user"), "events")


def append_to_graph(events: DataFrame, graph: VersionedGraph, checkpoint: str, label: str = "Event", id_col: str = "event_id") -> StreamingQuery:
    """Add each batch of rows as nodes in a commit of its own; a batch that is run again, after a failure or a restart, is committed once.

    The commit's manifest names the batch by the stream's checkpoint, so a restart must go on with the same checkpoint and the graph as stored.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if number <= graph.commits[-1].batches.get(checkpoint, -1):
            return
        change = graph.new_change()
        b = graph.buffer(change)
        props = [c for c in rows.columns if c != id_col]
        part = graph.add(change, "nodes", rows.select((F.lit(b.next_node) + F.monotonically_increasing_id()).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(id_col).cast("long").alias(id_col), *props))
        size = part.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).first()
        b.nodes, b.next_node = size["n"], (size["m"] if size["n"] else b.next_node - 1) + 1
        b.labels += [label] if label not in b.labels else []
        b.properties |= {f.name: f.dataType.simpleString() for f in part.schema.fields if f.name not in ("id", "labels")}
        b.batches[checkpoint] = number
        graph.submit(change)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
