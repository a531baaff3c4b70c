import random

import numpy as np
import xxhash

from graphloom.llm.simhash import fingerprint, keep_one, near_duplicates, op5_simhash


def plain(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(fps):
    names, out = sorted(fps), {}
    left = set(names)
    while left:
        seed = min(left)
        left.discard(seed)
        group, todo = {seed}, [seed]
        while todo:
            x = todo.pop()
            new = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2}
            left -= new
            group |= new
            todo += new
        out |= {x: seed for x in group}
    return out


def test_fingerprint():
    for t in (None, "", "  ", "One", "a b", "a b c", "The the THE the of\x0bx\x1cy Ä ä", "w " * 5000):
        assert fingerprint(t) == plain(t), t


def test_query_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_simhash(spark, sf).collect()
    fps = {i: plain(t) for i, t in docs.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == reachable(fps)


def test_components_of_planted_balls(spark, monkeypatch):
    """Chains and dense balls of fingerprints, in large blocks too."""
    import graphloom.llm.simhash as m

    rng = random.Random(3)
    fps = [0]
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(60):
            c2 = c
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                c2 ^= 1 << b
            fps.append(c2)
            if rng.random() < 0.1:
                c = c2
    fps += [rng.getrandbits(64) for _ in range(300)]
    want = reachable(dict(enumerate(fps)))
    monkeypatch.setattr(m, "fingerprints", lambda docs, **_: docs.selectExpr("doc_id", "fp"))
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    for limit in (512, 8):
        monkeypatch.setattr(m, "LARGE_BLOCK", limit)
        edges_u, edges_v = [], []
        uniq = {}
        for i, f in enumerate(fps):
            uniq.setdefault(f, i)
        fp = np.array(sorted(uniq), np.uint64)
        rep = np.array([uniq[int(f)] for f in fp])
        keys = m.block_keys(fp)
        for k in range(keys.shape[1]):
            order = np.argsort(keys[:, k], kind="stable")
            u, v = m.stars(fp[order], rep[order], keys[order, k])
            edges_u += u.tolist()
            edges_v += v.tolist()
        parent = {i: i for i in range(len(fps))}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(edges_u, edges_v):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert {i: find(uniq[f]) for i, f in enumerate(fps)} == want
    assert {r.doc_id: r.component_id for r in near_duplicates(rows).collect()} == want


def test_edges(spark, docs):
    t = "some words that make up a document of fair length, nothing more"
    d = docs([(5, None), (4, ""), (9, t), (7, t), (7, t), (None, t), (None, None), (1, "x y z " * 90_000), (2, "other words here")])
    rows = op5_simhash(spark, d).collect()
    assert len(rows) == 9
    assert {(r.doc_id, r.component_id) for r in rows} == {(5, 4), (4, 4), (9, 7), (7, 7), (None, 7), (None, 4), (1, 1), (2, 2)}
    df = spark.read.parquet(f"{d}/documents.parquet")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4", "7", "None", "None"]
    assert op5_simhash(spark, docs([])).count() == 0


def test_links_go_through_rows_without_an_id_and_through_long_chains(spark, monkeypatch):
    import graphloom.llm.simhash as m

    monkeypatch.setattr(m, "fingerprints", lambda docs, **_: docs.selectExpr("doc_id", "fp"))
    rows = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, -1)], "doc_id long, fp long")
    assert sorted((r.fp, r.doc_id, r.component_id) for r in near_duplicates(rows).collect()) == [(-1, None, None), (0, 1, 1), (3, None, 1), (15, 2, 1)]
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    assert {r.component for r in m.components(edges).collect()} == {0}
