import math

import numpy as np

from graphloom.llm.topk_search import BASE, CoverTree, op1_topk, search, search_large


def brute(qid, q, ids, data, k):
    s = data @ q
    return sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != qid)[:k]


def test_search_against_all_pairs():
    rng = np.random.default_rng(2)
    for dim, n, spread in ((3, 700, 6), (16, 900, 100), (2, 400, 1)):
        data = rng.integers(-spread, spread + 1, (n, dim)).astype(float)
        ids = rng.permutation(n * 3)[:n].astype(np.int64)
        pick = rng.choice(n, 90, replace=False)
        scores, found = search(ids[pick], data[pick], ids, data, 7)
        for row, k in enumerate(pick):
            assert [(-int(s), int(i)) for s, i in zip(scores[row], found[row])] == brute(ids[k], data[k], ids, data, 7)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    data = np.floor(1024 * np.array([r.embedding for r in rows], np.float64))
    got = {}
    for r in op1_topk(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {int(i): brute(i, data[k], ids, data, 10) for k, i in enumerate(ids) if i % 100 == 0}


def test_edges(spark, table):
    v = [1.0, 2.0]
    rows = [(0, v), (100, v), (1, v), (2, [1.0, None]), (3, None), (None, v), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, []), (7, [-3.0]), (8, v), (8, v), (200, [1e30, -1e30])]
    d = table("embeddings", rows, "vec_id long, embedding array<float>")
    got = {}
    for r in op1_topk(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 100, 200}
    assert got[0][:4] == [1, 8, 8, 100] and set(got[0]) == {1, 8, 100, 7, 200}
    assert got[200][0] in (1, 0, 7, 8)
    assert op1_topk(spark, table("embeddings", [], "vec_id long, embedding array<float>")).count() == 0
    one = op1_topk(spark, table("embeddings", [(0, v)], "vec_id long, embedding array<float>"))
    assert one.count() == 0


def test_the_tree_covers_and_separates_and_few_pairs_are_compared():
    rng = np.random.default_rng(4)
    points = np.unique(np.floor(1024 * (np.repeat(rng.normal(size=(40, 12)), 50, axis=0) + 0.02 * rng.normal(size=(2000, 12)))), axis=0)
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and any(tree.children)
    for node, (a, z) in enumerate(tree.span):
        away = np.linalg.norm(points[tree.order[a:z]] - points[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node]
        if tree.children[node]:
            reach = away.max() / BASE
            centres = [tree.centre[c] for c in tree.children[node]]
            assert all(tree.radius[c] <= reach * (1 + 1e-6) + 1e-3 for c in tree.children[node])
            apart = np.linalg.norm(points[centres][:, None] - points[centres][None], axis=2)
            assert (apart[np.triu_indices(len(centres), 1)] >= reach * (1 - 1e-9)).all()


def test_repeated_ids_and_large_components(spark, table):
    v, w = [1.0, 0.0], [0.5, 0.0]
    d = table("embeddings", [(100, v)] * 12 + [(200, v), (300, w)], "vec_id long, embedding array<double>")
    got = {}
    for r in op1_topk(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[100] == [(200, 2**20), (300, 2**19)]
    assert got[200] == [(100, 2**20)] * 10 and got[300] == [(100, 2**19)] * 10
    d = table("embeddings", [(100, [2.0**31]), (1, [1.0]), (2, [2.0**31 + 1 / 1024]), (3, [-(2.0**90)])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in op1_topk(spark, d).orderBy("rank").collect()] == [(2, 2**63 - 1), (1, 2**51), (3, -(2**63))]
    rng = np.random.default_rng(1)
    data = np.floor(rng.normal(size=(200, 5)) * 2.0**40)
    ids = np.arange(200)
    exact = {i: sorted((-sum(int(a) * int(b) for a, b in zip(data[i], data[j])), j) for j in range(200) if j != i)[:7] for i in range(20)}
    found = {}
    for q, i, s in search_large(ids[:20], data[:20], ids, data, 7):
        found.setdefault(q, []).append((-s, i))
    assert found == exact
