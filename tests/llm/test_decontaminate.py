import hashlib
import random
import re

from graphloom.llm.decontaminate import ItemAutomaton, decontaminate, op2_decontamination, scan_documents, words_of


def brute(words, items, window=8):
    hit, found = set(), set()
    for item, ws in items:
        n = min(window, len(ws))
        wins = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(hit), found


def test_automaton_against_windows():
    rng = random.Random(1)
    for _ in range(60):
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.choice([0, 1, 2, 4, 7, 8, 9, 15]))]) for k in range(6)]
        items = [(i, w) for i, w in items if len(w) != 1 or rng.random() < 0.2]
        auto = ItemAutomaton(items)
        for _ in range(5):
            words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.choice([0, 3, 40]))]
            spans, found = auto.scan(words)
            assert (sum(e - a for a, e in spans), found) == brute(words, items)


def test_query_against_windows(spark, sf):
    import pandas as pd

    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = [(str(i), split(t)) for i, t in zip(items.item_id, items.text)]
    got = {r.doc_id: r for r in op2_decontamination(spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for i, t in zip(docs.doc_id[:120], docs.text[:120]):
        words = split(t)
        n, found = brute(words, parts)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
        some += n > 0
    assert some


def test_edges_and_shards(spark, docs, table):
    item = "one two three four five six seven eight nine ten"
    long = "x " * 300_000
    d = docs([(1, None), (2, ""), (3, item), (3, item), (None, f"a b c d e f g h i j k l m n o p q r s t u v {item.upper()}! w"), (4, long + item), (5, "short one"), (6, "Ünïcode wörds only")])
    table("benchmark", [(7, item), (8, None), (9, ""), (10, "short one"), (11, "... !")], "item_id long, text string")
    docs_df, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = {(r.doc_id, r.n_words): r for r in op2_decontamination(spark, d).collect()}
    assert rows[1, 0].n_items == 0 and rows[2, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[3, 10].n_hit == 10 and rows[4, 300_010].n_hit == 10 and rows[5, 2].n_items == 1
    one = scan_documents(docs_df, items).select("doc_id", "hits").collect()
    many = scan_documents(docs_df, items, shard_words=8).select("doc_id", "hits").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    out = decontaminate(docs_df, items)
    assert out.columns == docs_df.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert set(kept) == {1, 2, None, 4, 6}
    assert kept[None].text == "a b c d e f g h i j k l m n o p q r s t u v  ! w" and kept[None].n_chars == len(kept[None].text)
    assert item not in kept[4].text and kept[1].text is None and kept[2].text == ""
    empty = docs_df.limit(0)
    assert decontaminate(empty, items).count() == 0 and decontaminate(docs_df, items.limit(0)).count() == 8


def test_words():
    assert words_of("It's A-B 9é Ω") == [b"it", b"s", b"a", b"b", "9é".encode(), "Ω".encode()]


def test_short_items_are_cut(spark):
    items = spark.createDataFrame([(1, "what is it"), (2, "forty two")], "item_id long, text string")
    rows = [(1, "a b c d e What is it? f g h i j k"), (2, "a b c d e f what is it forty two g h i j k"), (3, "a b what is c d")]
    out = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    got = {r.doc_id: " ".join(r.text.split()) for r in out.collect()}
    assert got == {1: "a b c d e ? f g h i j k", 2: "a b c d e f g h i j k", 3: "a b what is c d"}


def test_cutting_needs_one_python_worker(spark):
    """Idle workers take turns in the stages after, so a second worker of a task would hold a tokenizer, too."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "short one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i one two three four five six seven eight j"), (2, "a b c a short one d e f"), (3, None)], "doc_id long, text string")
    out = decontaminate(docs, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    many = decontaminate(docs, items, shard_words=8)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in many.collect()} == {(1, "a b c d e f g h i   j"), (2, "a b c a   d e f"), (3, None)}
