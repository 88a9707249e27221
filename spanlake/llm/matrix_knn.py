"""Nearest neighbours by a block matrix join with int8 tiles (operator 3).

Queries (rows whose id is divisible by ``QUERY_STEP``) are cut into blocks of at most
``QUERY_BLOCK`` rows, all vectors into blocks of about ``VECTOR_BLOCK``; a tile is one pair of
blocks, and Spark deals the tiles out by a cogroup on (query block, vector block). Blocks are
bounded, their number grows with the data; every vector is sent once per query block.

Inside a tile vectors are quantised to int8 with one scale per row. The product of two int8
matrices (exact in float32 arithmetic below 2**24, checked against the dimension) gives the
distance of the quantised vectors; the norms of the two quantisation errors bound how far
the true distance can be off (triangle inequality). A candidate survives when its lower
bound is not above the k-th smallest upper bound of its query; survivors are recomputed in
double precision on the original vectors. Heaps keep the k best of a tile; the tiles' sorted
lists are merged and cut at k in two steps, so that no row holds all lists of a query.

Results are exact: bounds never lose a neighbour, ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part; a query meets only vectors of its own dimension; fewer than k candidates give them
all; rows that repeat an id are rows of their own (each is a candidate of all but itself, and each
query row gives its own results); null ids take no part; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

NEIGHBOURS = 10
QUERY_STEP = 100
QUERY_BLOCK = 4_096
VECTOR_BLOCK = 1_024
#: Queries whose product with a vector block is held at once.
STRIP = 128
#: Tiles whose lists are merged in the first of the two steps.
MERGE = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(rid, id, v): vectors of finite components, not all zero, as doubles; ``rid`` tells rows apart once written."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(fine)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v")


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scale of each row, and the norm of each row's rounding error."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(m / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((m - q * scale[:, None]) ** 2).sum(axis=1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def tile(q_rid: np.ndarray, q: np.ndarray, v_rid: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """The k nearest rows of ``v`` for each row of ``q`` but itself: its place, sorted (distance, id)."""
    qi, qs, qe = quantise(q)
    vi, vs, ve = quantise(v)
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    vt = np.ascontiguousarray(vi.T.astype(kind))
    vn = (vi.astype(np.float64) ** 2).sum(axis=1) * vs**2
    for lo in range(0, len(q), STRIP):
        s = slice(lo, lo + STRIP)
        dot = (qi[s].astype(kind) @ vt).astype(np.float64) * qs[s, None] * vs[None, :]
        qn = (qi[s].astype(np.float64) ** 2).sum(axis=1) * qs[s] ** 2
        sq = np.maximum(qn[:, None] + vn[None, :] - 2 * dot, 0)
        # what the quantised distance itself can lose to rounding in double precision
        near = np.sqrt(sq)
        slack = qe[s, None] + ve[None, :] + 1e-6 * (np.sqrt(qn)[:, None] + np.sqrt(vn)[None, :])
        upper = near + slack
        own = q_rid[s, None] == v_rid[None, :]
        upper[own] = np.inf
        if len(v) > k:
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(upper), np.inf)
        row, col = np.nonzero((near - slack <= bound[:, None]) & ~own)
        for i in range(0, len(row), 1 << 16):  # bounds the rows gathered at once
            r, c = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
            d = distance(q[lo + r], v[c])
            if i == 0:
                held: dict[int, list[tuple[float, int]]] = {}
            order = np.argsort(r, kind="stable")
            cuts = np.flatnonzero(np.diff(r[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    n = int(r[part[0]])
                    held[n] = heapq.nsmallest(k, held.get(n, []) + list(zip(d[part].tolist(), v_id[c[part]].tolist())))
        if len(row):
            for n, best in held.items():
                yield lo + n, best


def _matrix(pdf: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row keys, ids and matrix of the rows of each dimension, from the last three columns."""
    out = {}
    size = pdf.iloc[:, -1].map(len)
    for d in sorted(size.unique()):
        part = pdf[size == d]
        out[int(d)] = part.iloc[:, -3].to_numpy(np.int64), part.iloc[:, -2].to_numpy(np.int64), np.stack(part.iloc[:, -1].to_numpy()).astype(np.float64)
    return out


def _tiles(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            vectors = _matrix(right)
            for dim, (q_rid, q_id, q) in _matrix(left).items():
                if dim in vectors:
                    for n, best in tile(q_rid, q, *vectors[dim], k):
                        rows += [(q_rid[n], q_id[n], int(key[1]), i, d) for d, i in best]
        kinds = {"rid": "int64", "query_id": "int64", "c": "int64", "vec_id": "int64", "score": "float64"}
        return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

    return run


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query among ``vectors`` (vec_id, embedding)."""
    rows = written(usable(vectors), "vectors")
    n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % step == 0, 1))).first()
    across, down = -(-n[0] // vector_block) or 1, -(-n[1] // query_block) or 1
    pick = lambda m, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.where(F.col("id") % step == 0).select(
        pick(down, 1).alias("q_block"), each(across).alias("q_tile"), F.col("rid").alias("q_rid"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    right = rows.select(each(down).alias("block"), pick(across, 2).alias("tile"), "rid", "id", "v")
    best = left.groupBy("q_block", "q_tile").cogroup(right.groupBy("block", "tile")).applyInPandas(_tiles(k), "rid long, query_id long, c long, vec_id long, score double")
    # the sorted lists of MERGE tiles meet first, so no row holds the lists of all tiles
    for group in ([F.col("rid"), F.col("query_id"), F.floor(F.col("c") / MERGE).alias("g")], [F.col("rid"), F.col("query_id")]):
        got = best.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("l"))
        best = got.select(*[c for c in got.columns if c != "l"], F.posexplode("l").alias("p", "e")).select(
            "rid", "query_id", "p", *[F.col(f"e.{c}").alias(c) for c in ("score", "vec_id")], *(["g"] if "g" in got.columns else []))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "vec_id", "score")
