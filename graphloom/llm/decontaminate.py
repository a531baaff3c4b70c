"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The items' words form one automaton. Documents stream through it word by word: the automaton's state is the longest
suffix read so far that occurs in an item, and its length decides whether a window of an item ends at the word.
Windows that occur give hit spans; spans over a length limit are cut out and documents over a coverage limit go.

Defined results: a null or empty text has no words, no hits and stays as it is; a null item or one without words has no
window; an item id that is null takes part as the string "null"; repeated rows are scanned each on its own; no items: no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import read_table, small_batches, staged

#: Words of one window.
WINDOW = 8
#: Words of items in one automaton; more items are dealt over several automata, used one after another.
SHARD_WORDS = 200_000

_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANK).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton of items, with the items of each window at the state that holds the window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.step)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.step[state][w]
                if i + 1 >= window:
                    self.windows.setdefault(self._holder(state, window), set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(self._holder(state, len(words)), []).append((len(words), item))
        # for a state that is at least a window long: the state of the window that ends there; for any: the nearest with short items
        order = sorted(range(n), key=self.length.__getitem__)
        self.holder, self.near = [-1] * n, [-1] * n
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.holder[s] = s if up < 0 or self.length[up] < window else self.holder[up]
            self.near[s] = s if s in self.short else self.near[up] if up >= 0 else -1

    def _holder(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state for the part of q's strings that p's strings and w make."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: bytes) -> int:
        if w in self.step[p]:
            q = self.step[p][w]
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit spans [first word, end) and the items whose windows occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        holder, near = self.holder, self.near
        found: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        some_short = bool(self.short)
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                while to is None and state > 0:
                    state = link[state]
                    matched = length[state]
                    to = step[state].get(w)
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= window:
                items |= self.windows[holder[state]]
                found.append([i - window + 1, i + 1])
            if some_short:
                s = near[state]
                while s >= 0:
                    for n, item in self.short[s]:
                        if n <= matched:
                            items.add(item)
                            found.append([i - n + 1, i + 1])
                    up = link[s]
                    s = near[up] if up >= 0 else -1
        return merged(found), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _shards(items: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in lists of bounded size; what one list may hold is checked before it is collected."""
    chosen = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    size = chosen.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    # a word takes two bytes at least with the blank after it
    shards = max(1, -(-int(size) // (2 * shard_words)))
    if shards == 1:
        yield [(r["item"], words_of(r["text"])) for r in chosen.collect()]
        return
    for k in range(shards):
        part = chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        yield [(r["item"], words_of(r["text"])) for r in part.collect()]


_HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def scan_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, hits_col: str = "hits") -> DataFrame:
    """docs with a struct column hits_col: n_words, spans (hit words, [first, end)), items (ids whose windows occur, sorted).

    An existing column of that name is replaced. The documents are never shuffled.
    """
    out, scan = _last_scan(docs, items, text_col, item_id_col, item_text_col, window, shard_words, hits_col)
    return out.mapInArrow(scan, out.schema)


def _last_scan(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, window: int, shard_words: int, hits_col: str) -> tuple[DataFrame, Callable]:
    """docs with the hits of all automata but the last, in hits_col at the end, and the last one's scan, a function of mapInArrow still to be applied."""
    spark = docs.sparkSession
    small_batches(spark)
    out, scan = docs.drop(hits_col).withColumn(hits_col, F.lit(None).cast(_HITS)), None
    for part in _shards(items, item_id_col, item_text_col, shard_words):
        if scan:
            out = staged(out.mapInArrow(scan, out.schema), "hits")
        model = spark.sparkContext.broadcast(ItemAutomaton(part, window))
        scan = _scanner(model, out.columns.index(text_col), out.columns.index(hits_col), hits_col)
    return out, scan


def _scanner(model, text_at: int, hits_at: int, hits_col: str):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches):
        automaton = model.value
        for b in batches:
            rows = []
            for text, old in zip(b.column(text_at).to_pylist(), b.column(hits_at).to_pylist()):
                words = words_of(text)
                spans, items = automaton.scan(words)
                if old:
                    spans, items = merged(spans + old["spans"]), items | set(old["items"])
                rows.append({"n_words": len(words), "spans": spans, "items": sorted(items)})
            columns = b.columns
            columns[hits_at] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_span_words: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without the spans of at least min_span_words hit words, and without the documents of which more than max_coverage of the words are hit.

    An item shorter than a window is one window: a span that is shorter, too, holds whole such items only, and is cut at any length.
    A cut leaves one blank. Documents without such a span come back as they are; n_chars_col, if docs has it, is counted anew for the others.
    The last scan and the cut are one Python step: two would keep a worker each, and idle workers take turns in later stages, so each gathers their memory.
    """
    hits = "__gl_hits"
    schema = docs.schema
    found, scan = _last_scan(docs, items, text_col, item_id_col, item_text_col, window, shard_words, hits)
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else -1

    def cut(batches):
        for b in scan(batches):
            columns = b.columns[:-1]
            texts, keep, counts = columns[text_at].to_pylist(), [], columns[chars_at].to_pylist() if chars_at >= 0 else None
            for k, h in enumerate(b.columns[-1].to_pylist()):
                keep.append(not h["n_words"] or sum(e - a for a, e in h["spans"]) <= max_coverage * h["n_words"])
                spans = [s for s in h["spans"] if s[1] - s[0] >= min_span_words or s[1] - s[0] < window]
                if spans and keep[-1]:
                    at = [m.span() for m in _WORD.finditer(texts[k])]
                    pieces, done = [], 0
                    for a, e in spans:
                        pieces.append(texts[k][done : at[a][0]])
                        done = at[e - 1][1]
                    texts[k] = " ".join([*pieces, texts[k][done:]])
                    if counts:
                        counts[k] = len(texts[k])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if counts:
                columns[chars_at] = pa.array(counts, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items whose windows occur and their digest; contaminated from two items on."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    parts = list(islice(_shards(read_table(spark, sf_dir, "benchmark"), "item_id", "text", SHARD_WORDS), 2))
    if len(parts) == 1:  # the digests come straight from the scan, so texts don't travel back
        model = spark.sparkContext.broadcast(ItemAutomaton(parts[0]))
        return docs.mapInArrow(_digests(model), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    hits = scan_documents(docs, read_table(spark, sf_dir, "benchmark"))
    n_items = F.size("hits.items").cast("long")
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        n_items.alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


def _digests(model):
    def run(batches):
        automaton = model.value
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column("text").to_pylist():
                words = words_of(text)
                spans, items = automaton.scan(words)
                for column, x in zip(out, (len(words), sum(e - a for a, e in spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


#: DuckDB: every window of every item as a joined string, joined with the documents' windows of as many words.
OP2_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin d JOIN wins x ON d.n = x.n AND d.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
