import random
import re

import pytest

from graphloom.llm import licenses
from graphloom.llm.licenses import TEMPLATES, op4_licenses, scan


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_planted_notices(spark):
    rng = random.Random(4)
    words = ["the", "a", "license", "under", "work", "of", "is", "released", "licensed", "and", "lorem", "ipsum"]
    rows, want = [], set()
    for i in range(400):
        name, notice = TEMPLATES[i % len(TEMPLATES)]
        fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
        rows.append((i, f"{fill(rng.randrange(40))}. {notice.upper() if i % 3 else notice}; {fill(rng.randrange(200))}"))
        want.add((i, name))
    got = {(r.doc_id, r.license) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {n: set(shingles(t)) for n, t in TEMPLATES}
    for i, text in rows:  # what is found holds the shingles
        for n in {n for d, n in got if d == i}:
            assert len(sets[n] & set(shingles(text))) >= 0.8 * len(sets[n])
    assert len(want & got) >= 0.99 * len(want)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: set(shingles(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, n) for i, s in docs.items() for n, t in TEMPLATES if len(s & set(shingles(t))) >= 0.8 * len(set(shingles(t)))}
    got = {(r.doc_id, r.license) for r in op4_licenses(spark, sf).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_edges(spark, docs):
    notice = "Released under the MIT License"
    long = "word " * 80_000
    rows = [(1, None), (2, ""), (3, "MIT License"), (4, notice), (5, notice), (5, notice), (None, notice), (6, f"{long}{notice} {long}{notice}")]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in op4_licenses(spark, docs(rows)).collect())
    assert got == [(4, "MIT", 0, 5), (5, "MIT", 0, 5), (6, "MIT", 80_000, 80_005), (6, "MIT", 160_005, 160_010)]
    assert op4_licenses(spark, docs([])).count() == 0
    with pytest.raises(ValueError):
        scan(spark.read.parquet(f"{docs(rows)}/documents.parquet"), (("X", "too short"),))


def test_few_files(spark, docs, monkeypatch):
    """Many shuffle partitions, none of them joined: the short tables and the result still are at most a file per core."""
    staged, made = licenses.staged, []
    monkeypatch.setattr(licenses, "staged", lambda df, label: made.append(staged(df, label)) or made[-1])
    many = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    sf = docs([(i, f"text {i}: {TEMPLATES[i % len(TEMPLATES)][1]}") for i in range(200)])
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        found = op4_licenses(spark, sf)
        found.write.parquet(f"{sf}/found")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(f"{sf}/found")
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(200))
    assert len(made) == 3 and all(len(t.inputFiles()) <= spark.sparkContext.defaultParallelism for t in [*made, out])
