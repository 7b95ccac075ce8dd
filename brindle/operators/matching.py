"""Nearest directions and one-to-one matching.

The sides are tables of directions (components, dictionary rows), not of documents. Rows are
compared in blocks: the smaller side is split, each task holds one block of it and streams the
other side, keeping the best match so far; blocks are then reduced by ``max_by``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import matrix_of

#: Rows of the looked-up side that a task may hold.
BLOCK = 4096


def nearest(queries: DataFrame, rows: DataFrame, *, key: str = "row_id", vec: str = "vec", absolute: bool = True, exclude_self: bool = False) -> DataFrame:
    """For each query the row of the largest (absolute) cosine, ties to the lower key: key,
    match, cosine. ``rows`` is dealt into blocks of BLOCK; every query meets every block."""
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    right = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t["id"].to_numpy()
        if not len(ids):
            return ids, np.zeros((0, 1))
        order = np.argsort(ids, kind="stable")
        m = matrix_of(t["v"].combine_chunks())
        return ids[order], (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))[order]

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        qi, q = unit(a)
        ri, r = unit(b)
        best_id, best = np.zeros(len(qi), np.int64), np.full(len(qi), -np.inf)
        if len(ri):
            for lo in range(0, len(qi), 1024):
                c = np.round(q[lo : lo + 1024] @ r.T, 9)
                w = np.abs(c) if absolute else c
                if exclude_self:
                    w = np.where(qi[lo : lo + 1024, None] == ri[None], -np.inf, w)
                k = w.argmax(axis=1)
                best_id[lo : lo + 1024], best[lo : lo + 1024] = ri[k], np.take_along_axis(w, k[:, None], 1)[:, 0]
        ok = np.isfinite(best)
        return pa.table({"id": qi[ok], "match": best_id[ok], "cosine": best[ok]})

    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(match, "id bigint, match bigint, cosine double")
    best = found.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("match")).alias("m"))).alias("b"))
    return best.select(F.col("id").alias(key), (-F.col("b.m")).alias("match"), F.col("b.cosine").alias("cosine"))


def extreme_products(queries: DataFrame, rows: DataFrame, k: int, *, key: str = "row_id", vec: str = "vec") -> DataFrame:
    """For each query the k rows with the largest dot product and the k with the least: key, match,
    product, side, rank. Ties to the lower key. Blocks as in ``nearest``."""
    blocks = max(1, -(-rows.count() // BLOCK))
    right = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            order = np.argsort(b["id"].to_numpy(), kind="stable")
            ids, r = b["id"].to_numpy()[order], matrix_of(b["v"].combine_chunks())[order]
            for i, q in zip(a["id"].to_pylist(), matrix_of(a["v"].combine_chunks()), strict=True):
                p = np.round(r @ q, 9)
                for side, sign in (("top", -1), ("bottom", 1)):
                    out += [(i, int(ids[j]), float(p[j]), side) for j in np.argsort(sign * p, kind="stable")[:k]]
        kinds = (("id", pa.int64()), ("match", pa.int64()), ("product", pa.float64()), ("side", pa.string()))
        return pa.table({n: pa.array([x[c] for x in out], t) for c, (n, t) in enumerate(kinds)})

    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(rank, "id bigint, match bigint, product double, side string")
    by = Window.partitionBy("id", "side").orderBy(F.when(F.col("side") == "top", -F.col("product")).otherwise(F.col("product")), "match")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).withColumnRenamed("id", key)


def most_isolated(rows: DataFrame, *, key: str = "row_id", vec: str = "vec") -> DataFrame:
    """The row whose nearest other row is farthest."""
    return nearest(rows, rows, key=key, vec=vec, exclude_self=True).orderBy("cosine", key).limit(1)


def assignment(weight: np.ndarray) -> np.ndarray:
    """Column for each row that maximises the total weight (rows <= columns), by shortest
    augmenting paths with potentials."""
    cost = -np.asarray(weight, float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        dist, used, via = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            reach = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free[1:] & (reach < dist[1:])
            dist[1:][better], via[1:][better] = reach[better], j0
            j1 = int(np.where(free, dist, np.inf).argmin())
            step = dist[j1]
            u[owner[used]] += step
            v[used] -= step
            dist[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def match_groups(pairs: DataFrame) -> DataFrame:
    """J14 per pair of runs. pairs: run_a, run_b, vecs_a, vecs_b (arrays of vectors; components of one
    run each). Returns run_a, run_b, a, b, similarity; the smaller run is matched wholly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ra, rb, va, vb in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = np.array(va, float), np.array(vb, float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                sim = np.abs(x @ y.T)
                if len(x) <= len(y):
                    pairs = enumerate(assignment(sim).tolist())
                else:
                    pairs = ((i, j) for j, i in enumerate(assignment(sim.T).tolist()))
                rows += [(ra, rb, i, j, float(sim[i, j])) for i, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64() if k == 4 else pa.int64()) for k in range(5)], names=["run_a", "run_b", "a", "b", "similarity"])

    return pairs.select("run_a", "run_b", "vecs_a", "vecs_b").mapInArrow(run, "run_a bigint, run_b bigint, a bigint, b bigint, similarity double")
