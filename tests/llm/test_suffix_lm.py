import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import suffix_lm
from graphloom.llm.suffix_lm import DEPTH, END, MIN_COUNT, SMOOTH, held_out, keys_of, op6_suffix_lm, word_keys

STOP = b""


class Slow:
    """The same model in dictionaries of tuples of words."""

    def __init__(self, texts):
        self.n = Counter()
        for t in texts:
            seq = [STOP, *self.words(t)]
            self.n.update((w,) for w in seq[1:])
            for size in range(2, DEPTH + 2):
                self.n.update(tuple(seq[k : k + size]) for k in range(len(seq) - size + 1))
        ones = [g for g in self.n if len(g) == 1]
        self.total, self.denominator = sum(self.n[g] for g in ones), sum(self.n[g] for g in ones) + 0.5 * (len(ones) + 1)
        self.vocabulary = [g[0] for g in ones]
        self.bow, self.p, self.retained = {}, {}, {()}
        for size in range(2, DEPTH + 2):
            followers = defaultdict(list)
            for g, n in self.n.items():
                if len(g) == size and n >= MIN_COUNT:
                    followers[g[:-1]].append(g)
            for c, grams in followers.items():
                if c[1:] not in self.retained:
                    continue
                n = self.n[c]
                bow = (SMOOTH + n - sum(self.n[g] for g in grams)) / (n + SMOOTH)
                up = {g: self.next(c[1:], g[-1]) for g in grams}
                p = {g: self.n[g] / (n + SMOOTH) + bow * up[g] for g in grams}
                rest, rest_up = max(1 - sum(p.values()), 1e-12), max(1 - sum(up.values()), 1e-12)
                divergence = sum(p[g] * math.log(p[g] / up[g]) for g in grams) + rest * math.log(rest / rest_up)
                if n * divergence >= 0.5 * math.log(max(n, 2)) * len(grams):
                    self.retained.add(c)
                    self.bow[c] = bow
                    self.p.update(p)

    @staticmethod
    def words(t):
        return (t or "").encode().lower().split() + [STOP]

    def next(self, context, w):
        if not context:
            return (self.n[(w,)] + 0.5) / self.denominator
        return self.p.get((*context, w)) or self.bow[context] * self.next(context[1:], w)

    def score(self, t):
        seq, out = [STOP, *self.words(t)], 0.0
        for k in range(1, len(seq)):
            d = next(d for d in range(min(DEPTH, k), -1, -1) if tuple(seq[k - d : k]) in self.retained)
            out += math.log10(self.next(tuple(seq[k - d : k]), seq[k]))
        return out


def check_base(rows, docs):
    split = {i: (t or "").encode().lower().split() + [b""] for i, t in docs}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in docs:
        if i is not None and not held(i):
            counts.update((t or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        words = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op6_suffix_lm(spark, sf).collect()
    check_base(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def random_rows():
    rng = random.Random(5)
    common = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(rng.randint(0, 150))]
        if i % 8 == 0:
            words[2:2] = [f"rare{i % 5}", f"seldom{i % 5}", f"scarce{i % 5}", f"few{i % 5}"]
        rows.append((i, " ".join(words)))
    return rows + [(400, None), (401, ""), (402, "w1 " * 3000), (None, "rare1 seldom1 scarce1 few1 w2"), (403, rows[7][1]), (404, rows[7][1]), (405, "x" * 5000 + " Never SEEN\x0bw1\u00a0w2")]


@pytest.mark.parametrize("hot", [1_000_000, 300, 0])
def test_scores_agree_with_the_slow_model(spark, docs, monkeypatch, hot):
    rows = random_rows()
    sf = docs(rows)
    slow = Slow([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where(~held_out()).collect()])
    assert all(any(len(c) == d for c in slow.retained) for d in range(DEPTH + 1))
    monkeypatch.setattr(suffix_lm, "HOT", hot)
    monkeypatch.setattr(suffix_lm, "BUCKET_ROWS", 500)
    monkeypatch.setattr(suffix_lm, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_lm, "PIECE_BYTES", 4000)
    got = op6_suffix_lm(spark, sf).collect()
    check_base(got, rows)
    texts = dict(rows)
    for r in got:
        assert math.isclose(r.score, slow.score(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9), r.doc_id


def test_distributions_sum_to_one():
    slow = Slow(["a b a b c a b", "b a b a c c d", "x y z a b a b", "a b a b a b a b", "d d a b c"] * 40)
    for c in slow.retained:
        assert math.isclose(sum(slow.next(c, w) for w in slow.vocabulary) + slow.next(c, b"never seen"), 1, rel_tol=1e-9)


def test_word_keys_are_of_words_alone():
    texts = [None, "", " ", "A b\tab  " + "é" * 40 + "\n" + "z" * 300, "ab" + " b" * 3, "abcdefgh abcdefghi abcdefg"]
    keys, place, tokens = keys_of(pa.array(texts))
    assert tokens.tolist() == [len(Slow.words(t)) for t in texts]
    assert (keys[place == 0] == END).all()
    by_word = defaultdict(set)
    for k, w in zip(keys.tolist(), [w for t in texts for w in [STOP, *Slow.words(t)]]):
        by_word[w].add(k)
    assert all(len(x) == 1 for x in by_word.values()) and len({k for x in by_word.values() for k in x}) == len(by_word)
    many = [f"word{k}" for k in range(200_000)]
    data = np.frombuffer(" ".join(many).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in many]) - 1
    assert len(np.unique(word_keys(data, ends - [len(w) for w in many], ends))) == len(many)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (4, "Ä b"), (4, "Ä b"), (None, "b c"), (6, "unseen words")]
    check_base(op6_suffix_lm(spark, docs(rows)).collect(), rows)
    assert op6_suffix_lm(spark, docs([])).count() == 0
    only_held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = op6_suffix_lm(spark, docs([(i, "a b") for i in only_held])).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2


def test_a_context_seen_twice_counts_however_large_the_corpus_is(spark, docs):
    rng = random.Random(6)
    filler = [(i, " ".join(rng.choice("abcdefghij") for _ in range(1000))) for i in range(60)]
    kept = [i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    rows = op6_suffix_lm(spark, docs(filler + [(i, "one only pair of rows says this") for i in kept])).collect()
    for r in rows:
        if r.doc_id in kept:
            assert r.score > r.base_score + 5


def test_the_tree_stays_packed(spark):
    """Many entries stand in one row from counting to scoring: rows of their own made the tree's joins cost more than its counting."""
    rows = [r[1] for r in random_rows() if r[0] is not None]
    base, weights = suffix_lm.train(spark.createDataFrame([(t,) for t in rows], "text string"))
    entries = suffix_lm.table_rows(weights).collect()
    slow = Slow(rows)
    assert (base.total, base.distinct) == (slow.total, len(slow.vocabulary)) == (sum(r.n for r in entries if r.known), sum(r.known for r in entries))
    assert len(entries) == len(slow.vocabulary) + len(slow.p) + len(slow.bow)
    assert weights.count() < len(entries) / 3


def test_order_of_keys_that_share_their_high_bits():
    rng = np.random.default_rng(3)
    for keys in (np.zeros(0), np.arange(1000)[::-1], rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 1000), np.repeat(np.arange(2)[::-1] + (1 << 62), 500)):
        keys = keys.astype(np.uint64)
        order = suffix_lm._order(keys)
        assert (keys[order] == np.sort(keys)).all() and sorted(order.tolist()) == list(range(len(keys)))


def test_a_task_that_reads_the_table_runs_one_python_worker(spark):
    """A second worker in front of it keeps a copy of what is broadcast, beside the executor's heap, while it waits."""
    _, weights = suffix_lm.train(spark.createDataFrame([(r[1],) for r in random_rows()], "text string"))
    assert "MapInArrow" not in weights._jdf.queryExecution().executedPlan().toString()


def test_a_worker_asks_in_pieces_that_need_little_memory(monkeypatch):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(50_000)]
    batch = pa.record_batch({"text": pa.array([" ".join(rng.choices(words, k=400)) for _ in range(1000)])})
    everything = suffix_lm.Bitmap(16, [])
    everything.bits[:] = 255
    nothing = suffix_lm.Rows(np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0))
    monkeypatch.setattr(suffix_lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows - b.column("n_tokens").null_count for b in suffix_lm._ask(SimpleNamespace(value=(nothing, everything)), 4, DEPTH)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1000
    assert peak < 48 << 20


def test_broadcast_rows_are_as_small_as_their_columns():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 20_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        rows = suffix_lm.Rows(keys, rng.random(n) < 0.1, rng.random(n))
        sent = pickle.dumps(rows, 5)
        again, asked = pickle.loads(sent), np.concatenate([keys, keys + np.uint64(1)])
        assert len(sent) <= 17 * n + 1000
        assert (again.find(asked) == rows.find(asked)).all() and (again.find(keys) >= 0).all()
        assert (again.known == rows.known).all() and (again.value == rows.value).all()
