import json

import pytest

from graphloom.engine import Engine
from graphloom.errors import ExecError
from graphloom.sources.gml import parse_gml
from graphloom.sources.results import encode, table

GML = """graph [ # a comment
  directed 1
  node [ id 1 label "A &amp; B" weight 1.5 ]
  node [ id 2 label "C" age 3 ]
  edge [ source 1 target 2 kind "x" ]
  edge [ source 2 target 2 ]
]"""


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "data").mkdir()
    return Engine(spark, str(tmp_path))


def rows(engine, text, graph):
    return [tuple(r) for r in engine.query(text, graph).collect()]


def test_gml(engine, tmp_path):
    (tmp_path / "data" / "small.gml").write_text(GML)
    assert rows(engine, "LOAD GML 'small.gml'", "default") == [("small",)]
    assert rows(engine, "MATCH (n:GMLNode) RETURN n.`label (String)` AS l, n.`weight (Double)` AS w, n.`age (Int64)` AS a ORDER BY l", "small") == [("A & B", 1.5, None), ("C", None, 3)]
    assert rows(engine, "MATCH (a)-[e:GMLEdge]->(b) RETURN a.`label (String)` AS x, e.`kind (String)` AS k ORDER BY x", "small") == [("A & B", "x"), ("C", None)]


@pytest.mark.parametrize("text", ["", "graph [ node [ id 1 ]", "graph [ node [ label \"a\" ] ]", "graph [ edge [ source 1 target 2 ] ]", "graph [ node [ id 1 ] node [ id 1 ] ]", "graph [ node ]", "graph [ node [ id 1 ] edge [ source 1 ] ]", "graph [ ! ]"])
def test_gml_errors(text):
    with pytest.raises(ExecError):
        parse_gml(text)


def test_json_export(engine, tmp_path):
    folder = tmp_path / "data" / "export"
    folder.mkdir()
    wrap = lambda rows: json.dumps({"results": [{"columns": ["x"], "data": [{"row": r} for r in rows]}], "errors": []})
    (folder / "nodes_0.json").write_text(wrap([[0, ["P"], {"name": "a", "age": 3, "ok": True}], [1, ["P", "Q"], {"name": "b", "age": "old", "size": 1.5}]]))
    (folder / "nodes_1.json").write_text(wrap([[2, ["Q"], {}]]))
    (folder / "edges_0.json").write_text(wrap([[0, 1, "T", {"w": 7}], [1, 2, "U", {}]]))
    assert rows(engine, "LOAD NEO4J 'export' AS ex", "default") == [("ex",)]
    assert rows(engine, "MATCH (n:P) RETURN n.`name (String)` AS n, n.`age (Int64)` AS a, n.`age (String)` AS b, n.`ok (Bool)` AS c, n.`size (Double)` AS d ORDER BY n", "ex") == [("a", 3, None, True, None), ("b", None, "old", None, 1.5)]
    assert rows(engine, "MATCH (a)-[e]->(b:Q) RETURN type(e), e.`w (Int64)` AS w ORDER BY type(e)", "ex") == [("T", 7), ("U", None)]
    with pytest.raises(ExecError):
        engine.query("LOAD NEO4J 'x.dump'")
    with pytest.raises(ExecError):
        engine.query("LOAD GML '../x.gml'")


def test_kinds_of_paths(engine, tmp_path):
    (tmp_path / "data" / "g.gml").write_text(GML)
    assert engine.import_path("g.gml", "one").name == "one"
    c = engine.query("CHANGE NEW", "one").first()[0]
    engine.query("MATCH (n) DELETE n", "one", change=c)
    engine.query("CHANGE SUBMIT", "one", change=c)
    assert engine.import_path(f"{tmp_path}/graphs/one", "two").history() == engine.graph("one").history()


def test_transfer_without_credentials(engine):
    with pytest.raises(ExecError):
        engine.query("S3 PULL 's3://bucket/key' 'here'")
    engine.query("S3 CONNECT 'id' 'key' 'eu-west-1'")
    assert engine.credentials


def test_copies_within_a_file_system(spark, tmp_path):
    from graphloom.sources import store

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    store.copy(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b" / "x.txt").read_text() == "x"
    store.write_text(spark, str(tmp_path / "m.json"), "é")
    assert store.read_text(spark, str(tmp_path / "m.json")) == "é"
    with pytest.raises(FileExistsError):
        store.write_text(spark, str(tmp_path / "m.json"), "again")


def test_encoded_results(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x long, y string")
    out = json.loads("".join(encode(df.coalesce(1), 2)))
    assert out["header"] == {"column_names": ["x", "y"], "column_types": ["Int64", "String"]}
    assert out["data"] == [[[1, 2], ["a", None]], [[3], ["c"]]] and out["time"] >= 0
    assert "null" in table(df) and table(df).count("\n") == 6


def test_paths_stay_in_the_folder_and_transfers_need_s3(spark, tmp_path):
    import pytest

    from graphloom.engine import Engine
    from graphloom.errors import ExecError

    folder = f"{tmp_path}/g"
    engine = Engine(spark, folder)
    assert engine.inside(f"{folder}/data/x") == f"{folder}/data/x" and engine.inside("x") == f"{folder}/data/x"
    for path in (f"{folder}-other/secret", "/etc/passwd"):
        assert engine.inside(path).startswith(f"{folder}/data/")
    with pytest.raises(ExecError):
        engine.inside("../x")
    engine.credentials = True
    for q in ("S3 PULL 'file:///etc/passwd' 'here'", "S3 PUSH 'here' '/tmp/out'"):
        with pytest.raises(ExecError):
            engine.query(q)


def test_identities_of_edges_are_the_same_in_every_scan(spark, tmp_path):
    from graphloom.sources.tables import edge_id, table_graph

    tables = table_graph(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    dealt = table_graph(spark, "/root/testdata/sf0.001", extras={"lineitem": lines.repartition(7, "l_tax")})
    for graph in (tables, dealt):
        e = Engine(spark, str(tmp_path))
        e.register("g", graph)
        got = [sorted(r[0] for r in e.query(f"MATCH ()-[l:{t}]->() RETURN l", "g").collect()) for t in ("CONTAINS", "SUPPLIED_BY", "PLACED", "IN_NATION")]
        assert all(len(set(x)) == len(x) for x in got) and (graph is tables or got == first)
        first = got
    plan = e.query("MATCH (o)-[l:CONTAINS {l_returnflag: 'R'}]->(p) RETURN l", "g")._jdf.queryExecution().executedPlan().toString()
    assert "monotonically" not in plan
    keys = spark.createDataFrame([(1, 2), (-1, 2), (1 << 28, 2), (1, 2)], "a long, b long").select(edge_id(3, (("a", 28), ("b", 28))).alias("x"))
    a, b, c, d = (r.x for r in keys.collect())
    assert a == d == 3 << 56 | 1 << 28 | 2 and b < 0 and c < 0 and b != c
