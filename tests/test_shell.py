import io

import pyarrow as pa

from graphloom.engine import Engine
from graphloom.operators import custom
from graphloom.shell import Shell


def test_session(spark, tmp_path):
    out = io.StringIO()
    s = Shell(Engine(spark, str(tmp_path)), out)
    (tmp_path / "x.txt").write_text("CREATE (a:P {name: 'x'});\nCREATE (b:P {name: null});")
    for line in ("help", "", "CHANGE NEW", "checkout change-1", f"read {tmp_path}/x.txt", "COMMIT", "MATCH (n:P) RETURN n.name ORDER BY n.name", "CHANGE SUBMIT", "MATCH (n:P) RETURN count(n)", "checkout nothing", "cd nothing", "checkout change-9", "MATCH (n", "sh echo hi", "read /no/file"):
        assert s.run(line)
    text = out.getvalue()
    assert "| x " in text and "null" in text and "| 2 " in text and s.change is None
    for part in ("COMMIT_NOT_FOUND", "GRAPH_NOT_FOUND", "CHANGE_NOT_FOUND", "PARSE_ERROR", "\nhi\n", "ERROR: "):
        assert part in text
    s.run("quiet")
    before = out.tell()
    s.run("MATCH (n:P) RETURN n.name")
    assert "| x" not in out.getvalue()[before:] and not s.run("q")


def test_types_that_clash_are_told_apart(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    a, b = (e.query("CHANGE NEW").first()[0] for _ in range(2))
    e.query("CREATE (n:P {k: 1})", change=a)
    e.query("CREATE (n:P {k: 'one'})", change=b)
    e.query("CHANGE SUBMIT", change=a)
    e.query("CHANGE SUBMIT", change=b)
    assert sorted(map(tuple, e.query("MATCH (n:P) RETURN n.k, n.`k (String)` AS s").collect()), key=str) == [(1, None), (None, "one")]


def test_custom_steps(spark):
    made = custom.source(spark, lambda n: [pa.record_batch({"x": pa.array([n, n + 10], pa.int64())})], "x long", 3)
    doubled = custom.transform(made, lambda b: pa.record_batch({"y": pa.array([2 * v for v in b.column(0).to_pylist()], pa.int64())}), "y long")
    assert sorted(r.y for r in doubled.collect()) == [0, 2, 4, 20, 22, 24]
    seen = spark.sparkContext.accumulator(0)
    custom.sink(doubled, lambda rows: seen.add(sum(r.y for r in rows)))
    assert seen.value == 72
