"""Nearest neighbours by vantage-point trees, one for each shard of the candidates.

A tree splits its points at the median distance from a vantage point, again and again down to leaves. A search skips a
side that the triangle inequality puts out of reach: farther than ``factor`` times the distance of the worst neighbour
kept. Factor 1 is exact; a smaller one skips more. Distances are chords between unit vectors, which order like cosines.

Queries stay distributed: they are dealt to blocks of about ``CHUNK``, candidates to shards by id, and every pair of a shard
and a block is one task's work, which builds the shard's tree and returns ``k`` candidates a query; the best of all shards
are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nubla.llm.common import table
from nubla.llm.vectors import matrices, usable

SHARD_BYTES = 48 << 20
LEAST_SHARD = 4096
CHUNK = 32_768
LEAF = 192


def _cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return np.einsum("qd,ld->ql", a, b) / (na[:, None] * nb)


class Tree:
    """A vantage-point tree over vectors with ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.norms = ids, vectors, np.sqrt((vectors * vectors).sum(1))
        unit = vectors / self.norms[:, None]
        order = np.argsort(ids, kind="stable")
        self.root = self._build(unit, order, leaf)

    def _build(self, unit: np.ndarray, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        d = np.sqrt(np.maximum(2 - 2 * unit[rows] @ unit[rows[0]], 0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return (unit[rows[0]], (d[near[0]], d[near[-1]]), (d[far[0]], d[far[-1]]), self._build(unit, rows[near], leaf), self._build(unit, rows[far], leaf))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0):
        """(scores, ids) of the k best for each query, its own id left out; -inf and -1 where there are fewer."""
        norms = np.sqrt((queries * queries).sum(1))
        unit = queries / norms[:, None]
        best, found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                score = _cosines(queries[q], self.vectors[node], norms[q], self.norms[node])
                score[ids[q][:, None] == self.ids[node]] = -np.inf
                some = score.max(1) >= best[q, -1]
                q, score = q[some], score[some]
                every = np.concatenate([best[q], score], 1)
                names = np.concatenate([found[q], np.broadcast_to(self.ids[node], score.shape)], 1)
                top = np.lexsort((names, -every), axis=1)[:, :k]
                best[q] = np.take_along_axis(every, top, 1)
                found[q] = np.where(np.isneginf(best[q]), -1, np.take_along_axis(names, top, 1))
                return
            vantage, near, far, inner, outer = node
            d = np.sqrt(np.maximum(2 - 2 * unit[q] @ vantage, 0))

            def within(at: np.ndarray, reach) -> np.ndarray:
                radius = factor * np.sqrt(np.maximum(2 - 2 * np.maximum(best[q[at], -1], -1), 0)) + 1e-7
                return at[(d[at] >= reach[0] - radius) & (d[at] <= reach[1] + radius)]

            first_inner = d <= (near[1] + far[0]) / 2
            a, b = np.flatnonzero(first_inner), np.flatnonzero(~first_inner)
            visit(inner, q[within(a, near)])
            visit(outer, q[within(a, far)])
            visit(outer, q[within(b, far)])
            visit(inner, q[within(b, near)])

        visit(self.root, np.arange(len(ids)))
        return best, found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k candidates of largest cosine for each query, ties to the smaller id.

    Both inputs: vec_id, embedding (other columns are not read). Rows with a null vec_id, or a vector that is null, empty,
    zero or not finite, take no part, and vectors of different lengths never meet. Of several vectors with one id the
    smallest counts, as arrays compare; a query never finds its own id. shard_rows: candidates of a shard; by default as many
    as ``SHARD_BYTES`` hold, fewer where that leaves tasks idle. Empty tables give an empty result.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asked = clean(vectors), table(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    n, longest = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    fair = max(LEAST_SHARD, n // vectors.sparkSession.sparkContext.defaultParallelism + 1)
    shards = max(1, -(-n // (shard_rows or min(fair, max(1, SHARD_BYTES // (8 * (longest or 1)))))))
    blocks = max(1, -(-asked.count() // CHUNK))
    place = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("shard", place(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", place(blocks)).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searcher(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _once(own: pa.Table) -> pa.Table:
    """One row for each id: the smallest of its vectors."""
    ids = own.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    if not first.all():
        begins = np.flatnonzero(first)
        keep = []
        for begin, end in zip(begins, [*begins[1:], len(ids)], strict=True):
            some = order[begin:end]
            keep.append(some[0] if len(some) == 1 else min(some, key=lambda i: own.column("embedding")[int(i)].as_py()))
        order = np.array(keep)
    return own.take(pa.array(order))


def _searcher(k: int, factor: float):
    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if own.num_rows and asked.num_rows:
            own = _once(own)
            names, ids = own.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            by_length = {m.shape[1]: (ids[rows], m) for rows, m in matrices(asked.column("embedding").combine_chunks())}
            for rows, m in matrices(own.column("embedding").combine_chunks()):
                if m.shape[1] in by_length:
                    q, x = by_length[m.shape[1]]
                    best, found = Tree(names[rows], m).search(q, x, k, factor)
                    at, place = np.nonzero(~np.isneginf(best))
                    out.append((q[at], found[at, place], best[at, place]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def op9_vector_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
