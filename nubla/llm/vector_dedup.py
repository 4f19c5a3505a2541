"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by its ``PREFIX`` nearest reference points in order. An inverted list for each reference point
holds the vectors that name it; two vectors of a list are candidates if they share ``SHARED`` reference points at least
(one is enough in a list of more than one block, or where there is no other), and they meet in the list of the first one
they share. Only candidates are verified, by cosine in double precision: a list is dealt out by the second reference point
first, so vectors that share none but the list's own never meet.

Equal vectors are one class from the start, so copies never meet each other. A long list is split into blocks by hash and
each pair of blocks is one task's work: numbers of links and a spanning set of links leave it, never all pairs. The
reference points are drawn from ``n / 100`` vectors (16 at least, ``MOST_PIVOTS`` or ``PIVOT_BYTES`` at most), the smallest
by a hash of their ids, so they grow with the table. One that is near another already taken (cosine of
``2 * threshold - 1`` or more) is left out, so that a large group of near copies holds few of them and its members name the
same ones; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import components, local_components, small, table
from nubla.llm.vectors import matrices, usable

THRESHOLD = 0.95
PREFIX = 6
SHARED = 2
BLOCK = 1536
LEAST_PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT, PIVOT_BYTES = 16, 65_536, 100, 128 << 20


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def _apart(vectors: pa.Array, most: float) -> pa.Array:
    """The vectors (of one length), in order, whose cosine to each one taken before is less than ``most``."""
    (_, m), = matrices(vectors)
    unit, taken = _unit(m), []
    for first in range(0, len(unit), 512):
        part = unit[first : first + 512]
        nearest = (part @ unit[taken].T).max(1) if taken else np.full(len(part), -np.inf)
        among = part @ part.T
        for i in range(len(part)):
            if nearest[i] < most:
                taken.append(first + i)
                nearest = np.maximum(nearest, among[i])
    return vectors.take(pa.array(taken, pa.int64()))


def _pivots(classes: DataFrame, threshold: float) -> pa.Array:
    """The reference points, for each length of vectors."""
    found, grain = [], 1 << 30
    for r in classes.groupBy(F.size("embedding").alias("size")).count().orderBy("size").collect():
        most = max(LEAST_PIVOTS, min(MOST_PIVOTS, PIVOT_BYTES // (8 * r["size"]), r["count"] // ROWS_PER_PIVOT))
        own = classes.filter(F.size("embedding") == r["size"]).select("embedding", F.xxhash64("rep").alias("h"), "rep")
        some = own.filter(F.pmod("h", F.lit(grain)) < min(grain, (2 * most + 40) * grain // r["count"]))
        drawn = some.orderBy(F.pmod("h", F.lit(grain)), "h", "rep").limit(most).select("embedding").toArrow().column("embedding")
        found.append(_apart(pa.concat_arrays(drawn.chunks), 2 * threshold - 1))
    return pa.concat_arrays(found) if found else pa.array([])


def _nearest(cosines: np.ndarray, prefix: int) -> np.ndarray:
    """The columns of the ``prefix`` largest numbers of each row, largest first."""
    if cosines.shape[1] > prefix:
        some = np.sort(np.argpartition(-cosines, prefix - 1, axis=1)[:, :prefix], axis=1)
    else:
        some = np.broadcast_to(np.arange(cosines.shape[1]), cosines.shape)
    order = np.argsort(-np.take_along_axis(cosines, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def _describe(pivots: pa.Array, prefix: int):
    """Arrow batches of (rep, n, embedding) -> the same with pivot and the whole description, a row for each of its pivots."""
    by_length = {m.shape[1]: (rows, _unit(m)) for rows, m in matrices(pivots)}

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                own = np.full((part.num_rows, prefix), -1, np.int32)
                for rows, m in matrices(part.column("embedding")):
                    if m.shape[1] in by_length:
                        names, unit = by_length[m.shape[1]]
                        order = _nearest(_unit(m) @ unit.T, prefix)
                        own[rows, : order.shape[1]] = names[order]
                row, place = np.nonzero(own >= 0)
                take = pa.array(row)
                described = pa.FixedSizeListArray.from_arrays(pa.array(own[row].ravel()), prefix).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(own[row, place]), part.column("rep").take(take), part.column("n").take(take), described, part.column("embedding").take(take)], ["pivot", "rep", "n", "described", "embedding"])

    return run


def candidates(described: np.ndarray, low: np.ndarray, high: np.ndarray, pivot: int, shared: int):
    """Ranges of rows (a, b) of the two blocks of a list: every candidate pair whose first shared reference point is
    ``pivot`` is in one of them, with the second one they share (-1: one is enough)."""
    if shared < 2:
        for i in range(0, len(low), 512):
            yield low[i : i + 512], high, -1
        return
    same = low is high
    rows = low if same else np.concatenate([low, high])
    row, place = np.nonzero(described[rows] > pivot)
    second, row, first_block = described[rows][row, place], rows[row], row < len(low)
    order = np.argsort(second, kind="stable")
    second, row, first_block = second[order], row[order], first_block[order]
    ends = np.flatnonzero(np.diff(second, append=-1))
    begins = np.concatenate([[0], ends + 1])[:-1]
    for begin, end in zip(begins, ends + 1, strict=True):
        if end - begin > 1:
            own, left = row[begin:end], first_block[begin:end]
            a, b = (own, own) if same else (own[left], own[~left])
            for i in range(0, len(a) if len(b) else 0, 512):
                yield a[i : i + 512], b, second[begin]


def _verify(threshold: float, shared: int):
    """A group (pivot, low, high) of two blocks, or one -> (rep, links, low): verified links of each, and a spanning set."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pivot, low, high = (k.as_py() for k in key)
        several = group.column("blocks")[0].as_py() > 1
        side = {n: group.column(n).combine_chunks() for n in ("rep", "n", "described", "embedding", "block")}
        rep, n, block = side["rep"].to_numpy(), side["n"].to_numpy(), side["block"].to_numpy()
        described = side["described"].flatten().to_numpy().reshape(len(rep), -1)
        links, ends = np.zeros(len(rep), np.int64), []
        for rows, m in matrices(side["embedding"]):
            unit, at = _unit(m), np.full(len(rep), -1)
            at[rows] = np.arange(len(rows))
            least = 1 if several else min(shared, int((described[rows] >= 0).sum(1).min()))
            first = rows[block[rows] == low]
            for a, b, second in candidates(described, first, first if low == high else rows[block[rows] == high], pivot, least):
                x, y = np.nonzero(unit[at[a]] @ unit[at[b]].T >= threshold)
                x, y = a[x], b[y]
                fit = x < y if low == high else np.ones(len(x), bool)
                x, y = x[fit], y[fit]
                for j in range(0, len(x), 100_000):
                    p, q = x[j : j + 100_000], y[j : j + 100_000]
                    same = (described[p][:, :, None] == described[q][:, None, :]).any(2) & (described[p] >= 0)
                    names = np.sort(np.where(same, described[p], np.iinfo(np.int32).max), axis=1)
                    fit = (names[:, 0] == pivot) & ((names[:, 1] == second) if second >= 0 else True)
                    p, q = p[fit], q[fit]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    ends.append((p, q))
        p, q = (np.concatenate(x) if ends else np.zeros(0, int) for x in (zip(*ends, strict=True) if ends else ((), ())))
        label = local_components(len(rep), p, q)
        smallest = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, rep)
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "low": smallest[label][some]})

    return run


def deduplicate(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    A row with a null vec_id, or with a vector that is null, empty, zero or not finite, links with nothing and is its own
    component. Repeated rows are vectors of their own and link with each other. Vectors of different lengths never link; very
    long ones leave fewer reference points. Other columns are not read; an empty table gives an empty result.
    """
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    classes = table(every.filter(fit).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    chosen = _pivots(classes, threshold)
    if not len(chosen):
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind = every.schema["embedding"].dataType.simpleString()
    lists = table(classes.select("rep", "n", "embedding").mapInArrow(_describe(chosen, prefix), f"pivot int, rep long, n long, described array<int>, embedding {kind}"), "lists")
    sizes = lists.groupBy("pivot").count().filter(F.col("count") > BLOCK)
    sizes = table(sizes.select(F.col("pivot").alias("own"), F.ceil(F.col("count") / BLOCK).cast("int").alias("several")), "sizes")
    dealt = lists.join(small(sizes, row=16), F.col("pivot") == F.col("own"), "left").withColumn("blocks", F.coalesce("several", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "n", "described", "embedding", "block", "blocks")
    found = table(dealt.groupBy("pivot", "low", "high").applyInArrow(_verify(threshold, shared), "rep long, links long, low long"), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = classes.join(linked, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = every.filter(fit).join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = every.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
