"""Hard-negative mining by angular triangle filtering (operator 13).

A row's score with an anchor is the inner product of their integer components
(floor(``SCALE`` * x)). Every row stores its norm and its angles to ``DIRECTIONS`` reference directions
of its dimension. By the triangle inequality on the sphere the angle between an anchor (angles f_j) and
a row (angles t_j) lies between max |f_j - t_j| and min (f_j + t_j), over the half turn the
complement; the cosines of these ends, times both norms and widened by more than
double precision can lose, bound the score. Only rows whose bounds overlap a wanted window get
integer scoring:

- positives: rows of the anchor's label whose upper bound reaches the ``POSITIVES``-th best lower
  bound of their tile;
- negatives: rows of other labels whose bounds overlap one of the anchor's windows (``LOW`` to ``HIGH``
  per cent of a positive's score) and reach the ``NEGATIVES``-th best lower bound of the rows that
  are surely inside it.

Work is dealt out as tiles, one block of anchors and one block of rows each (cogroup); positives
meet only blocks of their own label, whose number follows the label's size, so a label that a
third of all rows share is many blocks. Tiles keep sorted lists of bounded length, merged in two
steps. Results are exact.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no
part, nor do rows of another dimension than the anchor's; an empty or zero vector scores 0 with
everything; repeated rows are rows of their own (all but the anchor itself are candidates, and
each anchor row gives its own results); ties go to the smaller vec_id; fewer candidates give
them all; a positive without a negative in its window gives no row. Scores are longs: products
beyond that range are computed exactly and cut to it. Extra columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

SCALE = 256
STEP = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
DIRECTIONS = 8
#: Rows of a block of anchors and of a block of candidates.
ANCHOR_BLOCK = 2_048
ROW_BLOCK = 1_024
#: Anchors whose bounds with a block are held at once.
STRIP = 64
#: Tiles whose lists are merged in the first of the two steps.
MERGE = 64
#: What a cosine from stored angles can be off: arccos loses half the digits near 0 and a half turn.
SLACK = 1e-6
LONG = 2**63 - 1


def directions(dim: int, n: int = DIRECTIONS) -> np.ndarray:
    """The reference directions of a dimension: orthonormal (as far as they can be), the same everywhere."""
    m = np.random.Generator(np.random.PCG64(dim)).normal(size=(min(n, dim), dim))
    return np.linalg.qr(m.T)[0].T if dim else m


def stored(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the reference directions of the rows of a matrix."""
    size = np.abs(ints).max(axis=1, initial=0.0)
    size[size == 0] = 1.0  # scaled, so that no square overflows
    unit = ints / size[:, None]
    norm = np.sqrt((unit**2).sum(axis=1))
    unit = unit / np.where(norm > 0, norm, 1)[:, None]
    return norm * size, np.arccos(np.clip(unit @ directions(ints.shape[1]).T, -1, 1))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, vec_id, label, v) to the same with integer components (as doubles), norm and angles."""
    for b in batches:
        v = b.column(3)
        size = np.diff(v.offsets.to_numpy())
        flat, first = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), v.offsets.to_numpy() - v.offsets.to_numpy()[0]
        # a component beyond the doubles counts as the largest one
        flat = np.clip(np.nan_to_num(flat, posinf=np.finfo(float).max, neginf=-np.finfo(float).max), -1e300, 1e300)
        norm, angle = np.zeros(len(size)), [np.empty(0)] * len(size)
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            norm[at], found = stored(flat[first[at][:, None] + np.arange(dim)[None, :]])
            for i, a in zip(at, found):
                angle[i] = a
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in angle])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)),
             pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*angle, np.empty(0)])))],
            ["rid", "vec_id", "label", "w", "norm", "angles"])


def usable(vectors: DataFrame) -> DataFrame:
    """(rid, vec_id, label, w, norm, angles) of the rows that take part, written once; ``rid`` tells rows apart."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v")  # kept by the write below
    return written(rows.mapInArrow(_measure, "rid long, vec_id long, label long, w array<double>, norm double, angles array<double>"), "measured")


def score_bounds(a_norm: np.ndarray, a_angle: np.ndarray, norm: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all anchors with all rows. The cosine of the nearer end
    is the least cos(f - t), that of the farther end the greatest cos(f + t)."""
    shape = len(a_norm), len(norm)
    low, high = np.full(shape, -1.0), np.full(shape, 1.0)
    cos_a, sin_a, cos_b, sin_b = np.cos(a_angle), np.sin(a_angle), np.cos(angle), np.sin(angle)
    for j in range(a_angle.shape[1]):
        c, s = cos_a[:, j, None] * cos_b[None, :, j], sin_a[:, j, None] * sin_b[None, :, j]
        np.maximum(low, c - s, out=low)
        np.minimum(high, c + s, out=high)
    both = a_norm[:, None] * norm[None, :]
    return np.floor(both * (low - SLACK)), np.ceil(both * (high + SLACK))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all rows of ``b``, exact (cut to the longs)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(score) > 4 * k:  # ties of the k-th stay
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _rows(pdf: pd.DataFrame) -> dict[int, tuple]:
    """By dimension: positions in the frame, ids, labels, components, norms, angles."""
    out = {}
    size = pdf["w"].map(len).to_numpy()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        part = pdf.iloc[at]
        stack = lambda c: np.stack(part[c].to_numpy()).astype(np.float64).reshape(len(at), -1)
        out[int(d)] = at, part["rid"].to_numpy(), part["vec_id"].to_numpy(), part["label"].to_numpy(), stack("w"), part["norm"].to_numpy(), stack("angles")
    return out


def _strips(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
    """Strips of anchors with all rows of a block: what a tile needs of each, and the bounds."""
    rows = _rows(right)
    for dim, (at, rid, _, label, w, norm, angle) in _rows(left).items():
        if dim in rows:
            _, r_rid, r_id, r_label, r_w, r_norm, r_angle = rows[dim]
            for lo in range(0, len(at), STRIP):
                s = slice(lo, lo + STRIP)
                yield at[s], rid[s], label[s], w[s], r_rid, r_id, r_label, r_w, *score_bounds(norm[s], angle[s], r_norm, r_angle)


def _scored(w: np.ndarray, r_w: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that any anchor of the strip keeps, and the strip's scores with them."""
    cols = np.flatnonzero(keep.any(axis=0))
    return cols, scores(w, r_w[cols])


_FOUND = "rid long, c long, place int, score long, vec_id long"


def _frame(parts: list[tuple]) -> pd.DataFrame:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(5)]
    kinds = ("int64", "int64", "int32", "int64", "int64")
    return pd.DataFrame({c: x.astype(k) for c, x, k in zip(("rid", "c", "place", "score", "vec_id"), cols, kinds)})


def _positives(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            for _, rid, _, w, r_rid, r_id, _, r_w, low, high in _strips(left, right):
                own = rid[:, None] == r_rid[None, :]
                low[own] = -np.inf
                bound = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(rid), -np.inf)
                keep = (high >= bound[:, None]) & ~own
                cols, got = _scored(w, r_w, keep)
                for i, r in enumerate(rid):
                    mine = np.flatnonzero(keep[i, cols])
                    best = mine[_best(got[i, mine], r_id[cols[mine]], k)]
                    n = len(best)
                    parts.append((np.full(n, r), np.full(n, key[-1]), np.zeros(n), got[i, best], r_id[cols[best]]))
        return _frame(parts)

    return run


def _negatives(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            wanted = left["positive_scores"].to_numpy()
            for at, rid, label, w, _, r_id, r_label, r_w, low, high in _strips(left, right):
                other = label[:, None] != r_label[None, :]
                windows = [[window(int(p)) for p in wanted[i]] for i in at]
                keep = np.zeros(other.shape, bool)
                for i, mine in enumerate(windows):
                    for lo, hi in mine:
                        inside = other[i] & (low[i] >= lo) & (high[i] <= hi)
                        floor = max(lo, np.partition(low[i, inside], -k)[-k]) if inside.sum() > k else lo
                        keep[i] |= other[i] & (high[i] >= floor) & (low[i] <= hi)
                cols, got = _scored(w, r_w, keep)
                for i, mine in enumerate(windows):
                    own = np.flatnonzero(keep[i, cols])
                    score, ids = got[i, own], r_id[cols[own]]
                    for place, (lo, hi) in enumerate(mine):
                        fit = np.flatnonzero((score >= lo) & (score <= hi))
                        best = fit[_best(score[fit], ids[fit], k)]
                        n = len(best)
                        parts.append((np.full(n, rid[i]), np.full(n, key[-1]), np.full(n, place), score[best], ids[best]))
        return _frame(parts)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (rid, place) from the tiles' lists; the lists of MERGE tiles meet first, so that
    no row holds the lists of all tiles. Adds ``rank`` from 1."""
    for keys in (["rid", "place", "g"], ["rid", "place"]):
        rows = found.withColumn("g", F.floor(F.col("c") / MERGE)) if "g" in keys and "g" not in found.columns else found
        each = F.struct((-F.col("score")).alias("down"), "vec_id")
        got = rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(each)), 1, k).alias("l"))
        found = got.select(*keys, F.posexplode("l").alias("p", "e")).select(*keys, (F.col("p") + 1).alias("rank"), (-F.col("e.down")).alias("score"), "e.vec_id")
    return found


def _block(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(salt)), n).cast("int")


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, step: int = STEP,
         anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors``
    (vec_id, embedding, label)."""
    rows = usable(vectors)
    anchors = rows.where(F.col("vec_id") % step == 0)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    cols = ["rid", "vec_id", "label", "w", "norm", "angles"]
    again = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  the sides of a cogroup share no column

    # positives: the anchors of a label meet the blocks of that label
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % step == 0, 1)).alias("m")).where("m > 0").select(
        F.col("label").alias("of"), blocks(F.col("n"), row_block).alias("down"), blocks(F.col("m"), anchor_block).alias("across"))
    left = anchors.join(size, F.col("label") == F.col("of")).select(
        *again("of"), _block(F.col("across"), 1).alias("a"), each(F.col("down")).alias("c"), *again(*cols))
    right = rows.join(size, F.col("label") == F.col("of")).select("of", each(F.col("across")).alias("a"), _block(F.col("down"), 2).alias("c"), *cols)
    keys = ["of", "a", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_positives(positives), _FOUND)
    near = written(_merged(found, positives).select(F.col("rid").alias("a_rid"), "rank", "score", "vec_id"), "positives")

    # negatives: all anchors that have a positive meet all blocks
    n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % step == 0, 1))).first()
    down, across = -(-n[0] // row_block) or 1, -(-n[1] // anchor_block) or 1
    wanted = near.groupBy("a_rid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # at most ``positives``
    left = anchors.join(wanted, F.col("rid") == F.col("a_rid")).select(
        _block(F.lit(across), 3).alias("a"), each(F.lit(down)).alias("c"), *again(*cols), F.col("p.score").alias("positive_scores"))
    right = rows.select(each(F.lit(across)).alias("a"), _block(F.lit(down), 4).alias("c"), *cols)
    found = left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInPandas(_negatives(negatives), _FOUND)
    got = _merged(found, negatives)
    pair = near.select("a_rid", (F.col("rank") - 1).alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = rows.select(F.col("rid").alias("n_rid"), F.col("vec_id").alias("anchor_id")).where(F.col("vec_id") % step == 0)
    return got.join(pair, (F.col("rid") == F.col("a_rid")) & (F.col("place") == F.col("at"))).join(names, F.col("rid") == F.col("n_rid")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
