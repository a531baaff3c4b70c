import zlib

import numpy as np

from graphloom.llm import language_id as m
from graphloom.llm.language_id import KernelRidge, fit, keep_identified, op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges(spark, docs):
    d = docs([(1, None), (2, ""), (3, "12 34 !!"), (4, "Hello there"), (4, "Hello there"), (None, "and more words"), (5, "long words " * 60_000), (6, "nada"), (7, "Ünï")])
    rows = op10_language_id(spark, d).collect()
    assert len(rows) == 9
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in rows if r.doc_id not in (1, 2, 3)} == {"en"}
    df = spark.read.parquet(f"{d}/documents.parquet")
    out = keep_identified(df)
    assert out.columns == df.columns and out.count() == 6
    assert keep_identified(df.limit(0)).count() == 0


def test_without_a_learned_language_only_texts_without_letters_go(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for lang in ([None] * 5, ["en", None, None, None, None]):  # no label at all; a label on a held-out row only
        rows = list(zip((held, held + 1000, 7, 8, 9), ("Hello there", "more words", None, "12 !", "Ünï"), lang))
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert sorted(r.text for r in keep_identified(df).collect()) == ["Hello there", "more words", "Ünï"]


def test_folded_weights_are_the_explicit_kernel_machine():
    """The same regression from a kernel matrix that is summed up from sets, one pair of texts at a time."""
    rng = np.random.default_rng(3)
    letters = {"a": "abcde ", "b": "defgh ", "c": "hijab "}
    texts, labels = zip(*[("".join(rng.choice(list(letters[k]), 40)) + "x", k) for k in letters for _ in range(12)])
    new = ["".join(rng.choice(list("abcdefghij "), 30)) + "y" for _ in range(20)]
    slots = lambda t: [set(np.flatnonzero(m._presence([m._points(t)], n)[0])) for n in m.ORDERS]
    kernel = lambda x, y: sum(len(a & b) / max(1, (len(a) * len(b)) ** 0.5) for a, b in zip(x, y))
    sets = [slots(t) for t in texts]
    k_nm = np.array([[kernel(x, y) for y in sets] for x in sets])
    value, vector = np.linalg.eigh(k_nm)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ root
    y = np.array([[float(a == b) for b in "abc"] for a in labels])
    beta = np.linalg.solve(phi.T @ phi / 12 / 3 + m.RIDGE * np.eye(phi.shape[1]), phi.T @ y / 12 / 3)
    s = np.array([[kernel(slots(t), x) for x in sets] for t in new]) @ root @ beta
    e = np.exp(m.STEEP * (s - s.max(axis=1, keepdims=True)))
    langs, scores = KernelRidge.fit(list(texts), list(labels)).predict(new)
    assert langs == ["abc"[k] for k in s.argmax(axis=1)]
    assert np.allclose(scores, (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-3)


def test_the_fit_does_not_depend_on_the_rows_order(spark):
    rows = [(k % 20, f"{'ab' if k % 2 else 'xy'} text {k} " * 5, "en" if k % 2 else "fr") for k in range(200)] + [(5, "z" * 60_000, "en"), (7, "rare one", "la")]
    schema = "doc_id long, text string, lang string"
    models = [fit(spark.createDataFrame(r, schema).repartition(n), per_lang=6) for r, n in ((rows, 3), (rows[::-1], 2))]
    assert models[0].langs == models[1].langs == ["en", "fr", "la"]
    assert all(np.array_equal(a, b) for a, b in zip(models[0].weights, models[1].weights))
