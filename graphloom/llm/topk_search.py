"""Exact top-k search by inner product with cover trees over queries and data together.

Vectors are quantised to integers, floor(SCALE * x). The data are dealt into blocks of at most BLOCK_ROWS vectors, the queries into
blocks of at most QUERY_ROWS; a task takes one pair of blocks, builds a cover tree on each side and walks both trees
together. For centres q and r with covering radii s and t no pair below them scores more than
<q, r> + s |r| + t |q| + s t; a pair of nodes below every worst kth score of its queries goes. Equal bounds are looked into, so
that ties go to smaller ids exactly. Equal vectors share a point of the tree, with so many of their smallest ids as can matter.
Then each query's candidates of all blocks are ranked; a block passes on k rows of a query at most.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id.
Shorter vectors count as padded with zeros. A query's candidates are the rows with other ids than its own; repeated
candidate rows count each, up to k with the same id and vector; a repeated query id is answered once, for its
smallest vector. Products are exact whatever the components are; a score beyond 64 bits is held at their limits, as the column is a long.
Empty tables give no rows. Vectors are read whole, however long.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read_table, small_batches

SCALE, K = 1024, 10
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Points up to which a node of a tree isn't split.
LEAF = 8
#: Ratio of a node's covering radius to the radius that its children are to cover.
BASE = 2.0


class CoverTree:
    """Nodes as lists: centre, covering radius, greatest length below, children, and the span of their points in order.

    A node's children have centres taken farthest first, until they cover its points within a BASE-th of its radius; so every child's
    points lie within that of its centre (covering), and centres are further apart than that (separation). Every point belongs to the
    nearest centre. Points of which most would be centres have no structure at that scale, and stay together as a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.square = (points**2).sum(axis=1)
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.length: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        if len(points):
            self._build(int(self._distance(points.mean(axis=0), self.order).argmin()))

    def _distance(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[rows] + point @ point - 2 * (self.points[rows] @ point), 0))

    def _build(self, root: int) -> None:
        stack: list[tuple[int, int, int, int]] = [(root, 0, len(self.order), -1)]
        while stack:
            c, begin, end, parent = stack.pop()
            own = self.order[begin:end]
            near = self._distance(self.points[c], own)
            node, radius = len(self.centre), float(near.max())
            self.centre.append(c)
            self.radius.append(radius * (1 + 1e-9) + 1e-6)
            self.length.append(float(np.sqrt(self.square[own].max())) * (1 + 1e-9))
            self.children.append([])
            self.span.append((begin, end))
            if parent >= 0:
                self.children[parent].append(node)
            if len(own) <= LEAF or radius == 0:
                continue
            centres, which = [c], np.zeros(len(own), np.int64)
            while near.max() > radius / BASE and 2 * len(centres) <= len(own):
                centres.append(int(own[near.argmax()]))
                d = self._distance(self.points[centres[-1]], own)
                closer = d < near
                near[closer], which[closer] = d[closer], len(centres) - 1
            if near.max() > radius / BASE:
                continue
            self.order[begin:end] = own[np.argsort(which, kind="stable")]
            at = begin
            for k, n in enumerate(np.bincount(which, minlength=len(centres)).tolist()):
                if n:
                    stack.append((centres[k], at, at + n, node))
                    at += n


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (a row per query, -inf where fewer) of the exact top k of one block of integer vectors held as doubles."""
    none = np.iinfo(np.int64).max
    n = len(queries)
    scores, found = np.full((n, k), -np.inf), np.full((n, k), none)
    if not n or not len(data):
        return scores, found
    unique, which = np.unique(data, axis=0, return_inverse=True)
    which = which.ravel()
    tq, tr = CoverTree(queries), CoverTree(unique)
    # rows in the order of the tree's points, of equal vectors by id: k of an id can matter, and 2 k of all, as a query leaves out one id
    place = np.empty(len(unique), np.int64)
    place[tr.order] = np.arange(len(unique))
    order = np.lexsort((ids, place[which]))
    for same_id, most in ((True, k), (False, 2 * k)):
        at = place[which][order]
        starts = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (same_id & (np.diff(ids[order]) != 0))])
        order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < most]
    begin = np.searchsorted(place[which][order], np.arange(len(unique) + 1))
    rows_data, rows_id = data[order], ids[order]
    asked, asked_id, back = queries[tq.order], query_ids[tq.order], tq.order

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        """No pair below scores more: by lengths and centres' product, and by the least distance that radii leave."""
        c = [tr.centre[x] for x in nodes]
        t, far = np.array([tr.radius[x] for x in nodes]), np.array([tr.length[x] for x in nodes])
        q, s, long = tq.centre[a], tq.radius[a], tq.length[a]
        product = unique[c] @ queries[q]
        apart = np.sqrt(np.maximum(tr.square[c] + tq.square[q] - 2 * product, 0))
        by_product = product + s * np.sqrt(tr.square[c]) + t * np.sqrt(tq.square[q]) + s * t
        by_distance = (far**2 + long**2 - np.maximum(apart - s - t, 0) ** 2) / 2
        return np.minimum(by_product, by_distance) * (1 + 1e-9) + 1.0

    def compare(a: int, b: int) -> None:
        (qa, qz), (ra, rz) = tq.span[a], (begin[tr.span[b][0]], begin[tr.span[b][1]])
        s = asked[qa:qz] @ rows_data[ra:rz].T
        own = asked_id[qa:qz, None] == rows_id[None, ra:rz]
        if own.any():
            s[own] = -np.inf
        better = np.flatnonzero(s.max(axis=1) >= scores[back[qa:qz], -1])
        for j in better.tolist():
            q = back[qa + j]
            hit = np.flatnonzero((s[j] >= scores[q, -1]) & (s[j] > -np.inf))
            both_s, both_i = np.r_[scores[q], s[j, hit]], np.r_[found[q], rows_id[ra + hit]]
            best = np.lexsort((both_i, -both_s))[:k]
            scores[q], found[q] = both_s[best], both_i[best]

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, bound = stack.pop()
        qa, qz = tq.span[a]
        if bound < scores[back[qa:qz], -1].min():
            continue
        if not tq.children[a] and not tr.children[b]:
            compare(a, b)
        elif not tr.children[b] or tq.children[a] and tq.radius[a] >= tr.radius[b]:
            stack += [(x, b, float(bounds(x, [b])[0])) for x in tq.children[a]]
        else:
            value = bounds(a, tr.children[b])
            stack += [(a, tr.children[b][j], float(value[j])) for j in np.argsort(value)]  # the most promising is taken first
    return scores, found


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for k, x in enumerate(column):
        v = x.values.to_numpy()
        out[k, : len(v)] = v
    return out


def _exact(queries: np.ndarray, data: np.ndarray) -> bool:
    """Can sums of products of these integers be held exactly by doubles?"""
    with np.errstate(over="ignore"):
        return bool(queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) < 2**53)


def search_large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int = K) -> Iterator[tuple[int, int, int]]:
    """(query id, id, exact score) of the top k where doubles can't hold products: they tell which rows may be in it, and whole numbers decide."""
    top = max(np.abs(queries).max(initial=1.0), np.abs(data).max(initial=1.0), 1.0)
    small = data / top
    for qi, q in zip(query_ids.tolist(), queries):
        other = np.flatnonzero(ids != qi)
        if not len(other):
            continue
        about = small[other] @ (q / top)
        wrong = 4 * (len(q) + 4) * 2.0**-53 * (np.abs(small[other]) @ np.abs(q / top)) + 1e-300
        least = np.sort(about - wrong)[-min(k, len(other))]
        numbers = [int(x) for x in q]
        exact = sorted((-sum(x * int(y) for x, y in zip(numbers, data[r])), int(ids[r])) for r in other[about + wrong >= least].tolist())
        yield from ((qi, i, -s) for s, i in exact[:k])


def top_k(queries: DataFrame, data: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of data with the highest integer inner products for each row of queries."""
    small_batches(data.sparkSession)

    def quantised(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        good = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

        def whole(c):
            y = F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), c.cast("double") * scale))
            return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole numbers

        return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))

    base, asked = quantised(data), quantised(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, m = data.count(), queries.count()
    blocks, q_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    left = base.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)))

    def run(key, table):
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        vectors = table.column("v").combine_chunks()
        dim = max((len(v) for v in vectors), default=0)
        x = _matrix(vectors, dim)
        q_ids, q, d_ids, d = ids[asks], x[asks], ids[~asks], x[~asks]
        if _exact(q, d):
            scores, found = search(q_ids, q, d_ids, d, k)
        else:
            out = [(qi, i, max(-(2**63), min(2**63 - 1, x))) for qi, i, x in search_large(q_ids, q, d_ids, d, k)]
            return pa.table({c: pa.array([o[j] for o in out], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})
        good = ~np.isneginf(scores)
        return pa.table({"query_id": np.repeat(q_ids, good.sum(axis=1)).astype(np.int64), "vec_id": found[good].astype(np.int64), "score": scores[good].astype(np.int64)})

    best = rows.groupBy("block", "part").applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth vector."""
    data = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(data.where(F.col("vec_id") % 100 == 0), data)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
