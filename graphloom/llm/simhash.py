"""SimHash near-duplicates with pivot distance tables.

Every fingerprint gets a row of Hamming distances to reference fingerprints: the zero fingerprint, masks of two
neighbouring bits each, and further pseudo-random ones. Fingerprints at distance r differ by r at most in every column
(triangle inequality), so pairs with a larger coordinate difference go without being compared.

The columns also give the table's blocking. The distances to zero and to a two-bit mask tell how many of the two bits
are set. Two fingerprints that differ in RADIUS = 2 bits agree in all masks of at least two of four groups of eight masks,
so equal coordinates in a pair of groups (six pairs) bring together every linked pair: no link is lost. Blocks hold
different fingerprints only (exact copies are one class); a large block is cut further by the same rule on what
remains, and each block passes on a spanning star for each set of linked fingerprints, never all pairs.

Defined results: null and empty texts have no words and the fingerprint zero, which links like any other. Repeated rows
and ties share a component. Links go through rows with a null id like through any other, but a null id is never the smallest: a
component with only null ids is null. No documents: no rows. Very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read_table, remove, small_batches, staged

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Blocks of more fingerprints than this are cut further before pairs are looked at.
LARGE_BLOCK = 512
#: A list of ids is broadcast up to this length (16 bytes each at most).
BROADCAST_IDS = 200_000
#: Two-bit masks, and pseudo-random references from the golden-ratio sequence.
MASKS = np.array([3 << (2 * k) for k in range(32)], np.uint64)
EXTRA = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(31)], np.uint64)
#: The pairs of groups of eight masks.
KEYS = tuple(combinations(range(4), 2))

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, each weighing as often as it occurs."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):
        part = np.array(hashes[at : at + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Bits set under each mask, from the distances to zero and to the mask: d(x, 0) - d(x, mask) = 2 * set - 2."""
    zero = np.bitwise_count(fp).astype(np.int8)
    return (zero[:, None] - distances(fp, MASKS).astype(np.int8) + 2) >> 1


def block_keys(fp: np.ndarray) -> np.ndarray:
    """A column of block keys for each pair of groups; the pair's number is in the low bits."""
    c = coordinates(fp).astype(np.int64)
    powers = 3 ** np.arange(16, dtype=np.int64)
    return np.stack([(np.concatenate([c[:, 8 * a : 8 * a + 8], c[:, 8 * b : 8 * b + 8]], axis=1) @ powers) * len(KEYS) + k for k, (a, b) in enumerate(KEYS)], axis=1)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within RADIUS: first by the greatest coordinate difference, then by their own distance."""
    near = np.abs(table[a].astype(np.int8) - table[b].astype(np.int8)).max(axis=1) <= RADIUS
    a, b = a[near], b[near]
    linked = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    return a[linked], b[linked]


def _cut(rows: np.ndarray, c: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Parts of a large block in which every linked pair meets: equal coordinates in two of four groups of what masks vary."""
    varying = np.flatnonzero((c[rows] != c[rows[:1]]).any(axis=0))
    if len(rows) <= LARGE_BLOCK or depth >= 4 or len(varying) < 8:
        yield rows
        return
    groups, parts = [varying[(k + depth) % 4 :: 4] for k in range(4)], []
    for x, y in KEYS:
        columns = c[np.ix_(rows, np.concatenate([groups[x], groups[y]]))]
        _, which = np.unique(columns, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        parts += [part for part in np.split(rows[order], np.flatnonzero(np.diff(which[order])) + 1) if len(part) > 1]
    if sum(len(part) ** 2 for part in parts) > len(rows) ** 2 / 2:  # too alike for a cut to save work
        yield rows
        return
    for part in parts:
        yield from _cut(part, c, depth + 1)


def stars(fp: np.ndarray, ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by block: (id, smallest id linked to it within its block), for linked rows only."""
    n = len(fp)
    parent = np.arange(n)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= LARGE_BLOCK, sizes)
    pivots = np.concatenate([[np.uint64(0)], MASKS, EXTRA])
    pairs = []
    multi = np.flatnonzero(np.repeat(sizes > 1, sizes))
    table = np.zeros((n, len(pivots)), np.uint8)
    table[multi] = distances(fp[multi], pivots)
    for off in range(1, int(min(sizes.max(initial=1), LARGE_BLOCK + 1))):
        a = np.flatnonzero(small[off:] & (key[off:] == key[:-off]))
        if not len(a):
            break
        for at in range(0, len(a), 100_000):
            pairs.append(_links(fp, table, a[at : at + 100_000], a[at : at + 100_000] + off))
    for s, size in zip(starts[sizes > LARGE_BLOCK], sizes[sizes > LARGE_BLOCK]):
        rows = np.arange(s, s + size)
        c = coordinates(fp[rows])
        for part in _cut(np.arange(size), c, 0):
            part = part + s
            for k in range(len(part) - 1):
                x, y = _links(fp, table, np.full(len(part) - k - 1, part[k]), part[k + 1 :])
                for p, q in zip(x, y):  # into the forest at once, so that a large block's pairs are never kept
                    parent[_find(parent, int(q))] = _find(parent, int(p))
    for x, y in pairs:
        for p, q in zip(x.tolist(), y.tolist()):
            parent[_find(parent, q)] = _find(parent, p)
    root = np.array([_find(parent, k) for k in np.flatnonzero(parent != np.arange(n))], np.int64)
    mine = np.flatnonzero(parent != np.arange(n))
    if not len(mine):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    members, roots = np.concatenate([mine, np.unique(root)]), np.concatenate([root, np.unique(root)])
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids[members])
    u, v = ids[members], least[roots]
    return u[u != v], v[u != v]


def _key_rows(batches):
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys = block_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp.view(np.int64), len(KEYS)))], names=["key", "fp"])


def _star_rows(batches):
    """Blocks may run over batches: the last block of a batch waits for the next one."""
    held = None
    for b in (*batches, None):
        if b is not None:
            if not b.num_rows:
                continue
            new = [b.column(x).to_numpy() for x in ("key", "fp")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held[0][0] == held[0][-1]:
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))
        elif held is None:
            return
        else:
            end = len(held[0])
        key, fp = (np.ascontiguousarray(x[:end]) for x in held)
        held = [x[end:] for x in held]
        u, v = stars(fp.view(np.uint64), fp, key)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of edges (u, v) of longs.

    Every edge points from its larger node to its smaller one. A round hooks a node's smaller neighbours to the least of them, then lets every
    edge skip to what its end points to; rounds go on until nothing changes. Least neighbours are found by aggregates, which sum up before the
    shuffle, and brought back by joins of two written tables, whose hot keys Spark splits; no node's edges have to meet in one task.
    """
    both, seen = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        state = both.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        hooks = both.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hooked = staged(hooks.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(both, least)
        up = staged(hooked.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("top")), "least")
        both = staged(hooked.join(up, "v", "left").select("u", F.coalesce("top", "v").alias("v")).distinct(), "edges")
        remove(hooked, up)
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each document: component_id is the smallest id of the documents linked to it."""
    found = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    classes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = classes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_star_rows, "u long, v long")
    linked = components(edges)
    # components go by their least fingerprint, which has no row in linked; then they take the least id of theirs
    grouped = staged(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "linked")
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = staged(grouped.join(least, "component").select("fp", "component_id"), "components")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the row whose id is the component's; of repeated rows with that id, one. Rows with a null id stay."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col)
    dropped = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gl_id")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:  # else both sides are shuffled by id
        dropped = F.broadcast(dropped)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gl_id"))
    kept = docs.join(dropped, docs[id_col].cast("long") == F.col("__gl_id"), "left_anti")
    if repeated.isEmpty():
        return kept
    twice = kept.join(repeated, kept[id_col].cast("long") == F.col("__gl_id"), "left_semi")
    one = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(*(f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()))))
    return kept.join(repeated, kept[id_col].cast("long") == F.col("__gl_id"), "left_anti").unionByName(twice.withColumn("__gl_n", one).where("__gl_n = 1").drop("__gl_n"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint as 16 hex digits and component."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
