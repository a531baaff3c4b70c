from graphloom.engine import Engine
from graphloom.streaming.events import append_to_graph, event_stream, sessions, windowed_counts

SF = "/root/testdata/sf0.001"


def test_windows_and_sessions(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = event_stream(spark, f"{SF}/events*.parquet", events.schema)
    q = windowed_counts(stream, width="1 day").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r)[:4] for r in windowed_counts(events, width="1 day").collect()}
    got = {tuple(r)[:4] for r in spark.table("w").collect()}
    assert got and got <= batch  # windows that the watermark has passed
    s = sessions(events).agg({"events": "sum"}).first()[0]
    assert s == events.count()


def test_append(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "g"))
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = append_to_graph(event_stream(spark, str(tmp_path / "in"), events.schema), engine.graph(), str(tmp_path / "check"))
    q.awaitTermination()
    n = events.count()
    assert engine.query("MATCH (e:Event) RETURN count(e), count(DISTINCT e.event_id), count(DISTINCT e)").first()[:] == (n, n, n)
    assert len(engine.graph().commits) == 4


def test_a_batch_is_committed_once_over_restarts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    n = events.count()
    for restart in range(2):
        engine = Engine(spark, str(tmp_path / "g"))
        if restart:
            engine.query("LOAD GRAPH default") if "default" not in engine.graphs else None
        graph = engine.graph()
        append_to_graph(event_stream(spark, str(tmp_path / "in"), events.schema), graph, str(tmp_path / "check")).awaitTermination()
        assert graph.commits[-1].batches[str(tmp_path / "check")] == 0
        # the batch was committed, but the stream's own record of that is lost
        for f in (tmp_path / "check" / "commits").iterdir():
            f.unlink()
    assert engine.query("MATCH (e:Event) RETURN count(e)").first()[0] == n
