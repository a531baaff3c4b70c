import pytest

from graphloom.engine import Engine
from graphloom.errors import AnalyzeError, ChangeNotFound, CommitNotFound, ExecError, GraphNotFound, PlanError


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def rows(engine, text, **where):
    return [tuple(r) for r in engine.query(text, **where).collect()]


def new(engine):
    return engine.query("CHANGE NEW").first()[0]


def run(engine, *texts):
    c = new(engine)
    for t in texts:
        engine.query(t, change=c)
    engine.query("CHANGE SUBMIT", change=c)


def test_create_read_isolation_and_time_travel(engine):
    c = new(engine)
    assert rows(engine, "CREATE (a:P:Q {name: 'x', n: 1})-[:T {w: 0.5}]->(b:P {name: 'y'}) RETURN a.name, b.name", change=c) == [("x", "y")]
    with pytest.raises(AnalyzeError):  # not yet in the change's own view
        engine.query("MATCH (n:P) RETURN n", change=c)
    engine.query("COMMIT", change=c)
    assert rows(engine, "MATCH (n:P) RETURN n.name, n.n ORDER BY n.name", change=c) == [("x", 1), ("y", None)]
    assert rows(engine, "MATCH (n) RETURN count(*)") == [(0,)]
    engine.query("CHANGE SUBMIT", change=c)
    first = rows(engine, "CALL db.history()")[-1]
    assert first[1:] == (2, 1, 2)
    run(engine, "MATCH (n:P) CREATE (n)-[:T]->(m:R {name: n.name})")
    assert rows(engine, "MATCH (n)-[:T]->(m:R) RETURN n.name, m.name ORDER BY n.name") == [("x", "x"), ("y", "y")]
    assert rows(engine, "MATCH (n) RETURN count(*)", commit=first[0]) == [(2,)]
    with pytest.raises(CommitNotFound):
        engine.query("MATCH (n) RETURN n", commit="nothing")
    with pytest.raises(ChangeNotFound):
        engine.query("COMMIT", change=c)


def test_saved_graphs_load(spark, engine, tmp_path):
    run(engine, "CREATE (a:P {name: 'x'})")
    engine.query("CREATE GRAPH other")
    again = Engine(spark, str(tmp_path))
    assert rows(again, "MATCH (n:P) RETURN n.name") == [("x",)]
    assert rows(again, "LIST GRAPH") == [("default",)] and rows(again, "LOAD GRAPH other") == [("other",)]
    assert again.status("other") == {"name": "other", "isLoaded": True, "nodeCount": 0, "edgeCount": 0}
    with pytest.raises(GraphNotFound):
        again.query("LOAD GRAPH nothing")
    with pytest.raises(ExecError):
        again.query("CREATE GRAPH other")


def test_delete_takes_edges_along(engine):
    run(engine, "CREATE (a:P {name: 'x'})-[:T]->(b:P {name: 'y'}), (b)-[:T]->(c:P {name: 'z'})")
    run(engine, "MATCH (n {name: 'x'}) DELETE n")
    assert rows(engine, "MATCH (n) RETURN n.name ORDER BY n.name") == [("y",), ("z",)]
    assert rows(engine, "MATCH ()-[e]->() RETURN count(e)") == [(1,)]
    run(engine, "MATCH (n {name: 'y'})-[e]->() DELETE e")
    assert rows(engine, "MATCH ()-[e]->() RETURN count(e)") == [(0,)]


def test_set_remove_merge(engine):
    run(engine, "CREATE (a:P {name: 'x', n: 1})-[:T {w: 1}]->(b:P {name: 'y', n: 2})")
    run(engine, "MATCH (n:P {name: 'x'}) SET n.n = n.n + 10, n.tag = 'new', n:Extra", "MATCH (n:P {name: 'x'}) SET n += {n: 20}", "MATCH ()-[e:T]->() SET e.w = 5")
    assert rows(engine, "MATCH (n:P)-[e:T]->(m) RETURN n.n, n.tag, labels(n), e.w, m.n") == [(20, "new", ["P", "Extra"], 5, 2)]
    run(engine, "MATCH (n:Extra) REMOVE n.tag, n:Extra")
    assert rows(engine, "MATCH (n {name: 'x'}) RETURN n.tag, labels(n)") == [(None, ["P"])]
    run(engine, "MERGE (n:P {name: 'x'}) ON MATCH SET n.seen = true ON CREATE SET n.seen = false", "MERGE (n:P {name: 'q'}) ON MATCH SET n.seen = true ON CREATE SET n.seen = false", "MATCH (n:P) MERGE (n)-[:T]->(m:Leaf)")
    assert rows(engine, "MATCH (n:P) RETURN n.name, n.seen ORDER BY n.name") == [("q", False), ("x", True), ("y", None)]
    assert rows(engine, "MATCH (n:P)-[:T]->(:Leaf) RETURN count(*)") == [(3,)]


def test_rebase_and_conflicts(engine):
    run(engine, "CREATE (a:P {k: 1}), (b:P {k: 2})")
    a, b, c, d = (new(engine) for _ in range(4))
    engine.query("CREATE (:X {k: 10})-[:T]->(:X {k: 11})", change=a)
    engine.query("CREATE (:Y {k: 20})-[:T]->(:Y {k: 21})", change=b)
    engine.query("MATCH (n {k: 1}) DELETE n", change=c)
    engine.query("MATCH (n {k: 1}) CREATE (n)-[:T]->(:Z {k: 30})", change=d)
    assert rows(engine, "CHANGE LIST") == [(x,) for x in (2, 3, 4, 5)]
    engine.query("CHANGE SUBMIT", change=a)
    engine.query("CHANGE SUBMIT", change=b)
    assert rows(engine, "MATCH (n)-[:T]->(m) RETURN n.k, m.k ORDER BY n.k") == [(10, 11), (20, 21)]
    assert rows(engine, "MATCH (n) RETURN count(DISTINCT n), count(n)") == [(6, 6)]
    engine.query("CHANGE SUBMIT", change=c)
    with pytest.raises(ExecError, match="new edge"):
        engine.query("CHANGE SUBMIT", change=d)
    e = new(engine)
    f = new(engine)
    engine.query("MATCH (n {k: 2}) SET n.k = 3", change=e)
    engine.query("MATCH (n {k: 2}) DELETE n", change=f)
    engine.query("CHANGE SUBMIT", change=e)
    with pytest.raises(ExecError, match="nodes"):
        engine.query("CHANGE SUBMIT", change=f)
    g, h = new(engine), new(engine)
    engine.query("MATCH (n {k: 3}) CREATE (n)-[:T]->(:Z {k: 31})", change=g)
    engine.query("MATCH (n {k: 3}) DELETE n", change=h)
    engine.query("CHANGE SUBMIT", change=g)
    with pytest.raises(ExecError, match="new edges"):
        engine.query("CHANGE SUBMIT", change=h)
    for x in (d, f, h):
        engine.query("CHANGE DELETE", change=x)
    before = rows(engine, "MATCH (n) RETURN n.k, labels(n) ORDER BY n.k")
    engine.graph().merge()
    assert rows(engine, "MATCH (n) RETURN n.k, labels(n) ORDER BY n.k") == before
    assert len(rows(engine, "CALL db.history()")) == 1


def test_merge_creates_a_missing_pattern_once(engine):
    run(engine, "CREATE (z:Z {a: 1})", "COMMIT", "MATCH (z:Z) UNWIND [1, 1] AS x MERGE (z)-[:T]->(n:M {k: x})")
    assert rows(engine, "MATCH (z:Z)-[:T]->(n:M) RETURN n.k") == [(1,)]
    c = new(engine)
    made = rows(engine, "UNWIND [1, 1, 5] AS x MERGE (n:L {k: x}) RETURN x, n.k, n", change=c)
    assert sorted(r[:2] for r in made) == [(1, 1), (1, 1), (5, 5)] and len({r[2] for r in made}) == 2
    engine.query("CHANGE SUBMIT", change=c)
    c = new(engine)
    got = rows(engine, "UNWIND [1, 1, 5, 7, 7, 9] AS x MERGE (n:L {k: x}) ON CREATE SET n.c = 1 ON MATCH SET n.c = 2 RETURN x", change=c)
    assert sorted(got) == [(1,), (1,), (5,), (7,), (7,), (9,)]
    engine.query("CHANGE SUBMIT", change=c)
    assert rows(engine, "MATCH (n:L) RETURN n.k, n.c ORDER BY n.k") == [(1, 2), (5, 2), (7, 2), (9, 1)]
    run(engine, "MERGE (n:L {k: 9})", "MERGE (n:L {k: 10})")
    assert rows(engine, "MATCH (n:L) RETURN count(n)") == [(5,)]


@pytest.mark.parametrize(
    "text, error",
    [
        ("CREATE (n {k: 1})", AnalyzeError), ("CREATE (a:P)-[:T]-(b:P)", AnalyzeError), ("CREATE (a:P)-->(b:P)", AnalyzeError), ("CREATE (a:P {k: 'text'})", AnalyzeError), ("MATCH (n) DELETE m", AnalyzeError), ("MATCH (n) CREATE (n:P {k: 2})", AnalyzeError),
        ("CREATE (a:P) RETURN a UNION CREATE (b:P) RETURN b", PlanError), ("MATCH (n) SET n += 1", PlanError),
    ],
)
def test_write_errors(engine, text, error):
    run(engine, "CREATE (a:P {k: 1})")
    with pytest.raises(error):
        engine.query(text, change=new(engine))


def test_writes_need_a_change(engine):
    with pytest.raises(ExecError):
        engine.query("CREATE (a:P)")
    with pytest.raises(ExecError):
        engine.query("COMMIT")
    from graphloom.sources.tables import table_graph

    engine.register("tables", table_graph(engine.spark, "/root/testdata/sf0.001"))
    assert rows(engine, "MATCH (n:Region) RETURN count(n)", graph="tables") == [(5,)]
    with pytest.raises(ExecError):
        engine.query("CREATE (a:P)", "tables")
    assert rows(engine, "EXPLAIN MATCH (n:Region) RETURN n", graph="tables")
