"""Exact top-k by integer inner product: best-first search in an M-tree per shard.

Vectors become integers, floor(scale * x).  With a last coordinate that gives all
of a shard's vectors one length, the greatest inner product is the least
Euclidean distance, a metric, so the triangle inequality holds.

An M-tree node is a page of entries.  An entry of an inner page has a pivot, the
covering radius of its subtree and its distance to the page's own pivot; an entry
of a leaf is a vector and that distance.  A search keeps pages in a heap by the
least distance their vectors can have.  For a page it first uses the stored
parent distances, which rule out entries without any computation, then computes
distances for the rest.  Bounds carry a slack over rounding; scores are exact
integers.

Every query meets every shard: queries are dealt into blocks, vectors into
shards of a fixed size, and each (shard, block) is one task of bounded memory.
Only the k best of each come back.

Edge cases: vectors that are null or hold null or non-finite components, and
rows without id, take no part; shorter vectors end in zeros; repeated ids are
candidates each and never candidates of their own id; of repeated query ids the
least vector asks; equal scores go to the smaller id; with fewer than k
candidates all are returned; other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 512
FANOUT = 8
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048


class Page:
    """A node: leaf entries are vector numbers, inner entries have a pivot, a radius and a child page."""

    __slots__ = ("entries", "to_parent", "radius", "children")

    def __init__(self, entries, to_parent, radius=None, children=None):
        self.entries, self.to_parent, self.radius, self.children = entries, to_parent, radius, children


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = vectors.astype(np.float64)
        self.square = (self.exact**2).sum(1)
        # sums of products below 2**53 are exact in doubles, whose products are faster
        self.safe = float(np.abs(self.exact).max(initial=0)) ** 2 * max(1, vectors.shape[1]) < 2.0**52
        self.top = float(self.square.max())
        self.lift = np.sqrt(np.maximum(self.top - self.square, 0))
        self.slack = 1e-6 * (1 + np.sqrt(self.top))
        everything = np.arange(len(ids))
        self.pivot = 0
        self.root = self._page(everything, self._between(self.pivot, everything))

    def _between(self, one: int, others: np.ndarray) -> np.ndarray:
        """Distances of stored vectors, lifted to equal length."""
        product = self.exact[others] @ self.exact[one] + self.lift[others] * self.lift[one]
        return np.sqrt(np.maximum(2 * (self.top - product), 0))

    def _page(self, members: np.ndarray, to_parent: np.ndarray) -> Page:
        """A page for the members, given their distances to the pivot above."""
        if len(members) <= PAGE:
            return Page(members, to_parent)
        # pivots spread evenly over the members, which come in no order; each member joins the nearest
        picked = np.linspace(0, len(members) - 1, FANOUT).astype(np.int64)
        apart = np.stack([self._between(int(members[i]), members) for i in picked])
        owner = apart.argmin(0)
        if (owner == owner[0]).all():  # equal vectors: cut evenly
            owner = np.arange(len(members)) * FANOUT // len(members)
        groups = [(i, np.flatnonzero(owner == i)) for i in range(FANOUT)]
        groups = [(i, g) for i, g in groups if len(g)]
        children = [self._page(members[g], apart[i, g]) for i, g in groups]
        at = picked[[i for i, _ in groups]]
        return Page(members[at], to_parent[at], np.array([apart[i, g].max() for i, g in groups]), children)

    def _scores(self, members: np.ndarray, query: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.safe and float(np.abs(q).max(initial=0)) ** 2 * max(1, len(q)) < 2.0**52:
            return (self.exact[members] @ q).astype(np.int64)
        return self.vectors[members] @ query

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (-score, id) of all vectors whose id is not `own`."""
        q = query.astype(np.float64)
        base = float(q @ q) + self.top
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        start = float(np.sqrt(max(base - 2 * (self.exact[self.pivot] @ q), 0)))
        heap = [(0.0, 0, self.root, start)]
        serial, limit = 0, np.inf
        while heap:
            least, _, page, above = heapq.heappop(heap)
            if least > limit + self.slack:
                break
            slackened = limit + self.slack
            gap = np.abs(above - page.to_parent)
            if page.children is None:
                rest = page.entries[gap <= slackened]
                scores, ids = self._scores(rest, query, q), self.ids[rest]
                if len(best) == k:  # equal scores still compete by id
                    some = scores >= best[0][0]
                    scores, ids = scores[some], ids[some]
                for s, i in zip(scores.tolist(), ids.tolist()):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = float(np.sqrt(max(base - 2 * best[0][0], 0)))
            else:
                some = np.flatnonzero(gap - page.radius <= slackened)
                if not len(some):
                    continue
                d = np.sqrt(np.maximum(base - 2 * (self.exact[page.entries[some]] @ q), 0))
                least = np.maximum(d - page.radius[some], 0)
                for j, low, to in zip(some.tolist(), least.tolist(), d.tolist()):
                    if low <= slackened:
                        serial += 1
                        heapq.heappush(heap, (low, serial, page.children[j], to))
        return sorted((-s, -i) for s, i in best)


def matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x) for x in column.to_pylist()]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    kept = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(x, fit))
    return kept.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).cast("array<long>").alias("v")
    )


def top_k(
    table: DataFrame, asks: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for every row that `asks` (a condition on vec_id)."""
    rows = integer_vectors(table, vec_id, vector, scale)
    queries = rows.where(asks).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    count = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(count))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")).withColumn("shard", every(shards))

    def run(_, stored, queries):
        out = []
        if stored.num_rows and queries.num_rows:
            a, b = matrix(stored.column("v")), matrix(queries.column("v"))
            width = max(map(len, a + b))
            tree = MTree(stored.column("vec_id").to_numpy(), padded(a, width))
            for own, q in zip(queries.column("vec_id").to_pylist(), padded(b, width)):
                out += [(own, i, -s) for s, i in tree.search(q, own, k)]
        return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
