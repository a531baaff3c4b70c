import pytest
from graphs import social

from graphloom.errors import AnalyzeError, ExecError
from graphloom.operators import access, explore, search


@pytest.fixture(scope="module", params=["columns", "tables"])
def graph(request, spark):
    return social().graph(spark) if request.param == "columns" else social().split(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lists(graph):
    assert rows(explore.list_labels(graph, ["Maker"])) == [("City", 0), ("Interest", 0), ("Person", 3)]
    assert ("name",) in rows(explore.list_property_types(graph)) and rows(explore.list_property_types(graph, [20])) == [("name",), ("size",)]
    assert rows(explore.list_edge_types(graph)) == [("KNOWS",), ("LIKES",), ("LIVES_IN",)] and rows(explore.list_edge_types(graph, [0, 5])) == [("KNOWS",), ("LIKES",)]
    page, last = explore.list_nodes(graph, ["Person", "Unknown"], {"name": "O", "other": "x"}, limit=5)
    assert rows(page) == [(1, ["Person"])] and last
    page, last = explore.list_nodes(graph, ["Person"], skip=1, limit=2)
    assert [r.id for r in page.collect()] == [1, 2] and not last


def test_nodes_and_edges(graph):
    assert rows(explore.node_properties(graph, [0, 13])) == [(0, "age", "31"), (0, "member", "true"), (0, "name", "Ana")]
    near = explore.neighbors(graph, [1, 4], limit=2).collect()
    assert len(near) == 2 and all(r.id == 1 and not r.reached_end for r in near)
    assert all(r.reached_end for r in explore.neighbors(graph, [3], limit=3).collect())
    loop = [r for r in explore.neighbors(graph, [3]).collect() if r.other == 3]
    assert sorted(r.out for r in loop) == [False, True]
    shown = explore.node_edges(graph, [1], {"LIKES": 1}).collect()
    assert sorted((r.type, r.out, r.total) for r in shown if r.type == "LIKES") == [("LIKES", True, 2)]
    assert rows(explore.get_nodes(graph, [21]).select("id", "labels", "name")) == [(21, ["City"], "Rome")]
    assert rows(explore.get_edges(graph, [3]).select("src", "dst", "type")) == [(2, 0, "KNOWS")]
    assert rows(explore.explore_node_edges(graph, 1, labels=["Interest"], node_parts={"name": "ch"}, exclude_in=True).select("type", "other")) == [("LIKES", 10), ("LIKES", 10)]
    assert rows(explore.explore_node_edges(graph, 1, types=["KNOWS"], limit=1, skip=1).select("type")) == [("KNOWS",)]
    assert explore.explore_node_edges(graph, 1, exclude_in=True, exclude_out=True).count() == 0
    with pytest.raises(AnalyzeError):
        explore.explore_node_edges(graph, 1, types=["NOPE"])


def test_access(graph, spark):
    assert access.scan_nodes(graph, ["City"]).count() == 2
    assert rows(access.scan_edges(graph, ["Maker"], ["Interest"]).select("src", "dst")) == [(0, 10), (0, 12), (2, 11)]
    assert access.scan_edges(graph).count() == 14
    assert rows(access.scan_node_property(graph, "age", ["Person"])) == [(0, 31), (1, 45), (3, 28), (4, 31)]
    assert access.scan_edge_property(graph, "since").count() == 9
    ids = spark.createDataFrame([(0,), (2,), (2,)], "id long")
    assert rows(access.properties_of(graph, ids, "age")) == [(0, 31)] and len(rows(access.properties_of(graph, ids, "age", True))) == 3
    assert access.edges_of(graph, ids, "both").count() == 6 + 2 * 4
    view = access.node_views(graph, spark.createDataFrame([(3,)], "id long")).first()
    assert len(view.out) == 2 and len(view["in"]) == 1 and view.properties["name"] == "Di"
    assert rows(access.label_sets(graph, ["Person"])) == [(["Maker", "Person"], 3), (["Person"], 2)]
    assert rows(access.counts(graph)) == [(11, 14)]


def test_word_search(graph, spark):
    index = spark.createDataFrame([("economy", 1), ("econ", 2), ("ecology", 3), ("tea", 4), ("t", 5)], "word string, id long")
    assert rows(search.search_words(index, "Economy!")) == [(1,)]  # seven letters: begins with five, six have to occur
    assert rows(search.search_words(index, "economists")) == []  # eight have to occur
    assert rows(search.search_words(index, "econ")) == [(1,), (2,), (3,)]  # begins with three, four have to occur
    assert rows(search.search_words(index, "ecoz")) == []
    assert len(rows(search.search_words(index, "t"))) == 5
    assert rows(search.search_words(index, "tea econ")) == [(1,), (2,), (3,), (4,)]
    assert rows(search.search_words(index, "...")) == []
    assert ("chess", 10) in rows(search.word_index(graph, "name", ("Interest",)))


def test_vectors(spark):
    import random

    rng = random.Random(3)
    data = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    lib = search.VectorLibraries(spark)
    v = lib.create("v", 8, "l2")
    with pytest.raises(ExecError):
        lib.create("v", 8)
    with pytest.raises(ExecError):
        v.search([0.0] * 8, 3)
    v.add(spark.createDataFrame(data, "id long, embedding array<double>"))
    q = data[17][1]
    want = sorted((sum((a - b) ** 2 for a, b in zip(x, q)), k) for k, x in data)[:5]
    assert [r.id for r in v.search(q, 5, exact=True).collect()] == [k for _, k in want]
    assert v.search(q, 5).first().id == 17
    best = sorted((-sum(a * b for a, b in zip(x, q)), k) for k, x in data)[:5]
    assert [r.id for r in search.nearest(v.df, q, 5, "ip").collect()] == [k for _, k in best]
    with pytest.raises(AnalyzeError):
        v.search([1.0], 1)
    assert rows(lib.list()) == [("v", 8, "l2")] and lib.exists("v")
    lib.delete("v")
    assert not lib.exists("v")


def test_bucketed_search_recall(spark):
    """Of the ten nearest of every hundredth vector, at least 0.9 are found within the queries' reach."""
    from graphloom.queries import LSH_REACH, vector_topk_lsh

    sf = "/root/testdata/sf0.1"
    data = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    found = {}
    for r in vector_topk_lsh(spark, sf).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.id
    assert set(found) == {i for i in data if i % 100 == 0} and all(sorted(x) == list(range(1, 11)) for x in found.values())
    hits = 0
    for q, ids in found.items():
        best = sorted((-sum(a * b for a, b in zip(data[q], x)), i) for i, x in data.items() if i != q)[:10]
        hits += len({i for _, i in best} & set(ids.values()))
    assert LSH_REACH < 10 and hits >= 0.9 * 10 * len(found)
