from collections import Counter

import pytest
from graphs import social

from graphloom.errors import AnalyzeError, PlanError
from graphloom.queries import cypher

P, I, C, ANY = {"Person"}, {"Interest"}, {"City"}, set()
CASES = [
    ("MATCH (a) RETURN a", [("a", ANY)], []),
    ("MATCH (a:Person:Maker) RETURN a", [("a", {"Person", "Maker"})], []),
    ("MATCH (a:Interest:City) RETURN a", [("a", I | C)], []),
    ("MATCH (a)-[:KNOWS]->(b) RETURN a, b", [("a", ANY), ("b", ANY)], [("a", "out", "KNOWS", "b")]),
    ("MATCH (a:Maker)<-[:KNOWS]-(b) RETURN a, b", [("a", {"Maker"}), ("b", ANY)], [("a", "in", "KNOWS", "b")]),
    ("MATCH (a)--(b) RETURN a, b", [("a", ANY), ("b", ANY)], [("a", "both", None, "b")]),
    ("MATCH (a:Person)-[:KNOWS]-(b:Person) RETURN a, b", [("a", P), ("b", P)], [("a", "both", "KNOWS", "b")]),
    ("MATCH (a)-->(b)-->(c) RETURN a, b, c", [("a", ANY), ("b", ANY), ("c", ANY)], [("a", "out", None, "b"), ("b", "out", None, "c")]),
    ("MATCH (a:Person)-[:LIKES]->(i)<-[:LIKES]-(b) RETURN a, b", [("a", P), ("i", ANY), ("b", ANY)], [("a", "out", "LIKES", "i"), ("i", "in", "LIKES", "b")]),
    ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a) RETURN a, b, c", [("a", ANY), ("b", ANY), ("c", ANY)], [("a", "out", "KNOWS", "b"), ("b", "out", "KNOWS", "c"), ("c", "out", "KNOWS", "a")]),
    ("MATCH (a)-[:KNOWS]->(a) RETURN a", [("a", ANY)], [("a", "out", "KNOWS", "a")]),
    ("MATCH (a)-[:KNOWS]-(a) RETURN a", [("a", ANY)], [("a", "both", "KNOWS", "a")]),
    ("MATCH (a:City), (i:Interest) RETURN a, i", [("a", C), ("i", I)], []),
    ("MATCH (a)-[:KNOWS]->(b), (a)-[:LIVES_IN]->(c), (b)-[:LIKES]->(i) RETURN a, b, c, i", [("a", ANY), ("b", ANY), ("c", ANY), ("i", ANY)], [("a", "out", "KNOWS", "b"), ("a", "out", "LIVES_IN", "c"), ("b", "out", "LIKES", "i")]),
    ("MATCH (a)-[:LIVES_IN]->(c) MATCH (b)-[:LIVES_IN]->(c) MATCH (a)-[:KNOWS]-(b) RETURN a, b, c", [("a", ANY), ("b", ANY), ("c", ANY)], [("a", "out", "LIVES_IN", "c"), ("b", "out", "LIVES_IN", "c"), ("a", "both", "KNOWS", "b")]),
    ("MATCH (x)<-[:LIKES]-(a)-[:KNOWS]->(b)-[:LIKES]->(x) RETURN x, a, b", [("x", ANY), ("a", ANY), ("b", ANY)], [("a", "out", "LIKES", "x"), ("a", "out", "KNOWS", "b"), ("b", "out", "LIKES", "x")]),
]


@pytest.fixture(scope="module", params=["columns", "tables"])
def graph(request, spark):
    return social().graph(spark) if request.param == "columns" else social().split(spark)


@pytest.mark.parametrize("text, nodes, hops", CASES)
def test_against_nested_loops(graph, text, nodes, hops):
    names = [x.strip() for x in text.partition("RETURN")[2].split(",")]
    want = Counter(tuple(b[n] for n in names) for b in social().match(nodes, hops))
    assert Counter(tuple(r) for r in cypher(graph, text).collect()) == want


def rows(graph, text, **params):
    return sorted((tuple(r) for r in cypher(graph, text, **params).collect()), key=str)


def test_null_logic(graph):
    assert rows(graph, "MATCH (n:Person) WHERE n.member RETURN n.name") == [("Ana",), ("Cy",)]
    assert rows(graph, "MATCH (n:Person) WHERE NOT n.member RETURN n.name") == [("Bo",), ("Ed",)]
    assert rows(graph, "MATCH (n:Person) WHERE n.member IS NULL OR n.age > 40 RETURN n.name") == [("Bo",), ("Di",)]
    assert rows(graph, "MATCH (n:Person) WHERE n.age = null RETURN n.name") == [("Cy",)]
    assert rows(graph, "MATCH (n:Person) WHERE n.age <> 31 RETURN n.name") == [("Bo",), ("Di",)]
    assert rows(graph, "MATCH (n:Person) WHERE n.age > 30 XOR n.member RETURN n.name") == [("Bo",), ("Ed",)]
    assert rows(graph, "MATCH (i:Interest) RETURN i.name ORDER BY i.name DESC LIMIT 2") == [("Tea",), (None,)]
    assert rows(graph, "MATCH (c:City) WHERE c.size IS NOT NULL AND c.size = 0.5 RETURN c.name") == [("Oslo",)]


def test_edges_and_walks(graph):
    assert rows(graph, "MATCH (a)-[e:LIKES {since: 2007}]->(i) RETURN a.name, type(e), i.name, labels(i)") == [("Bo", "LIKES", "Chess", ["Interest"])]
    assert rows(graph, "MATCH (a {name: 'Ana'})-[e]->(x) WHERE e.since IS NULL RETURN type(e)") == [("KNOWS",)]
    g = social()
    walks = sum(len(g.match([(str(k), {"Person"} if k == 0 else set()) for k in range(n + 1)], [(str(k), "out", "KNOWS", str(k + 1)) for k in range(n)])) for n in (1, 2, 3))
    assert rows(graph, "MATCH (a:Person)-[e:KNOWS*1..3]->(b) RETURN count(*)") == [(walks,)]
    assert rows(graph, "MATCH p = (a {name: 'Ana'})-[:KNOWS*2]->(b) RETURN b.name, length(p), size(nodes(p))") == [("Ana", 2, 2), ("Cy", 2, 2)]
    assert rows(graph, "MATCH (a:City)-[*0..1]-(b) RETURN a.name, count(b)") == [("Oslo", 3), ("Rome", 2)]
    assert rows(graph, "MATCH (a {name: 'Di'})-[e]->(b) RETURN startNode(e) = endNode(e), b.name") == [(False, "Maps"), (True, "Di")]


def test_clauses(graph):
    assert rows(graph, "MATCH (p:Person) OPTIONAL MATCH (p)-[:LIVES_IN]->(c) WHERE c.name = 'Oslo' RETURN p.name, c.name") == [("Ana", "Oslo"), ("Bo", None), ("Cy", "Oslo"), ("Di", None), ("Ed", None)]
    assert rows(graph, "MATCH (p:Person) WHERE NOT (p)-[:KNOWS]-() RETURN p.name") == [("Ed",)]
    assert rows(graph, "MATCH (p:Person) RETURN p.name, COUNT { (p)-[:LIKES]->() } AS n ORDER BY n DESC, p.name LIMIT 2") == [("Ana", 2), ("Bo", 2)]
    assert rows(graph, "MATCH (c:City) RETURN c.name, size(COLLECT { (p)-[:LIVES_IN]->(c) RETURN p.name }) AS n") == [("Oslo", 2), ("Rome", 1)]
    assert rows(graph, "MATCH (p:Person) WITH p.age AS age, count(*) AS n WHERE n > 1 RETURN age, n") == [(31, 2)]
    assert rows(graph, "MATCH (p:Person)-[:LIKES]->(i) WITH p, i WHERE p.member MATCH (p)-[:LIVES_IN]->(c) RETURN p.name, i.name, c.name") == [("Ana", "Chess", "Oslo"), ("Ana", "Maps", "Oslo"), ("Cy", "Tea", "Oslo")]
    assert rows(graph, "UNWIND $list AS x RETURN x, x % 2 = 0 AS even", list=[1, 2]) == [(1, False), (2, True)]
    assert rows(graph, "MATCH (p:Person) RETURN count(*) AS n, count(p.age) AS a, min(p.age) AS low, max(p.name) AS high, avg(p.age) AS mean") == [(5, 4, 28, "Ed", 33.75)]
    assert rows(graph, "MATCH (c:City) RETURN DISTINCT labels(c) AS l UNION ALL MATCH (i:Interest) RETURN labels(i) AS l") == [(["City"],)] + [(["Interest"],)] * 4
    assert rows(graph, "MATCH (p:Maker) RETURN keys(p) AS k ORDER BY size(k), k") == [(["age", "member", "name"],), (["age", "member", "name"],), (["member", "name"],)]
    assert cypher(graph, "MATCH (p:Person) RETURN *").columns == ["p"]
    assert cypher(graph, "MATCH (p:Person) RETURN p.name, p.age + 1 AS next").columns == ["p.name", "next"]
    assert rows(graph, "CALL db.labels() YIELD label WHERE label STARTS WITH 'C' RETURN label") == [("City",)]
    assert rows(graph, "RETURN [1, 2, 3][-1] AS a, [1, 2, 3][0..2] AS b, none(x IN [1] WHERE x > 1) AS c, CASE 2 WHEN 1 THEN 'a' ELSE 'b' END AS d, 7 / 2 AS e, 2 ^ 3 AS f, $p.k AS g", p={"k": 5}) == [(3, [1, 2], True, "b", 3, 8.0, 5)]


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n:Nope) RETURN n", "MATCH ()-[:NOPE]->() RETURN 1 AS x", "MATCH (n) RETURN n.nope", "MATCH (n) WHERE m.name = 'a' RETURN n", "MATCH (n) WHERE n.name = 1 RETURN n", "MATCH (n) WHERE n.name < 1 RETURN n", "MATCH (n) WHERE n.name RETURN n",
        "MATCH (n) WHERE count(n) > 1 RETURN n", "MATCH (n) RETURN n LIMIT -1", "MATCH (n) RETURN n SKIP 1.5", "MATCH (n) RETURN nofunction(n)", "MATCH (n) RETURN n.name AS a, n.age AS a", "MATCH (a)-[e]->(b)-[e]->(c) RETURN a", "MATCH (a)-[a]->(b) RETURN b",
        "MATCH (n) RETURN n.name ORDER BY m.x", "CALL nope()", "MATCH (n) CALL db.labels() RETURN n", "RETURN 'a' * 2 AS x", "RETURN NOT 1 AS x", "MATCH (n) RETURN n.name UNION MATCH (n) RETURN n.age", "RETURN $missing AS x", "MATCH (n) WITH n.name RETURN 1 AS x", "MATCH (n) RETURN avg(n.name)", "MATCH (n) RETURN count(count(n))",
    ],
)
def test_analysis_errors(graph, text):
    with pytest.raises(AnalyzeError):
        cypher(graph, text)


@pytest.mark.parametrize("text", ["MATCH (a)-[*]->(b) RETURN a", "MATCH (a)-[*1..99]->(b) RETURN a", "MATCH (n)"])
def test_plan_errors(graph, text):
    with pytest.raises(PlanError):
        cypher(graph, text)
