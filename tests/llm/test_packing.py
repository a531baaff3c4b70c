import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from graphloom.llm.packing import WordTokenizer, op3_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding == 0
    return by_seq


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op3_packing(spark, sf).collect(), docs)


def test_edges(spark, docs):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "<|endoftext|> a  b   c\n d\n\n  e \t f", 5: " lead", 6: "trail ", 7: "a\0 b", 8: "Ünï  　 x y", 9: " ", 10: "\n \n"}
    d = docs(texts.items())
    seqs = check(op3_packing(spark, d).collect(), texts)
    assert sum(len(p) == 1 and p[0].length == 1024 for p in seqs.values())
    assert op3_packing(spark, docs([])).count() == 0
    rows = pack(spark.createDataFrame([(None, "x y"), (3, "z"), (3, "z")], "doc_id long, text string"), keep_ids=True).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["3", "3", "None"]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_words_give_the_same_ids():
    import random

    rng = random.Random(5)
    choice = ["a", "Bc", " ", " ", "  ", "\n", "\t", "\v", "\x1c", "\r", ".", "'s", "12", "é", "\u3000", "\u2003", "\x85", "\xa0", "\u1680", "\u202f", "语", "😀", "\0", "!!", "<|endoftext|>"]
    texts = ["".join(rng.choice(choice) for _ in range(rng.randrange(30))) for _ in range(3000)]
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    expected = [t.encode(x, add_special_tokens=False).ids for x in texts]
    plain, small = WordTokenizer(PATH), WordTokenizer(PATH, remember=50)
    assert plain.fast is not None
    slow = WordTokenizer(PATH)
    slow.fast = None
    for w in (plain, plain, small, slow):
        for at in range(0, 3000, 1000):
            assert [np.frombuffer(x, "<u4").tolist() for x in w.batch(pa.array(texts[at : at + 1000]))] == expected[at : at + 1000]
    assert plain.batch(pa.array([None, ""])) == [b"", b""] and plain.batch(pa.array([], pa.string())) == []


def test_every_character_gives_the_same_ids():
    """Each code point among letters, digits and signs; also such as are white space, or none, by other rules."""
    t, w = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    t.encode_special_tokens = True
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 53)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [f"a{chr(c)}1{chr(c)}! {chr(c)} " for c in points[at : at + 4096]]
        assert [np.frombuffer(x, "<u4").tolist() for x in w.batch(pa.array(texts))] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
