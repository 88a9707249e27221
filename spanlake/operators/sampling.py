"""Seeded shuffles, exact-size samples and splits (F1-F4) on a distributed exact rank
(F9).

The permutation is the order of ``md5('<seed>|<key>')`` (ties by key): the same rows
come out on any partitioning and after any executor loss, because nothing depends on
task order or random state.

``global_rank`` never sorts all rows in one partition. Rows are bucketed by a prefix
of the order key; bucket sizes (a table of at most ``16**digits`` rows, a proven
bound) give each bucket's offset; ranks inside a bucket come from ``row_number`` over
``partitionBy(bucket)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.session import cut_lineage

MAX_DIGITS = 5  # a million offsets at most are broadcast
PLACE_BITS = 33  # fixed value: bits of a row's number inside its partition in monotonically_increasing_id
DEFAULT_DIGITS = 4  # 65,536 buckets: ~1.5M rows per bucket at 1e11 rows; offsets <= 65,536 rows


def hash_key(key_cols: list[str], seed: int) -> Column:
    """``md5('<seed>|<k1>|<k2>...')`` as a lower-case hex string."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def global_rank(
    df: DataFrame,
    order: list[Column],
    bucket: Column,
    rank_col: str = "rank",
    with_total: bool = False,
    broadcast_offsets: bool = True,
    first: int | None = None,
) -> DataFrame:
    """Exact 1-based rank of every row by ``order``; ``bucket`` must be a prefix
    (monotone function) of that order. With ``broadcast_offsets`` the caller
    guarantees a bounded number of bucket values; otherwise the planner sizes the
    offsets join itself. With ``first`` only buckets that hold one of the first ranks are
    kept, before any row is shuffled."""
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(w_all), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"),
    )
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    w = Window.partitionBy("_bucket").orderBy(*order)
    # offsets has one row per bucket value (16**digits for hash buckets: a proven bound)
    ranked = b.join(F.broadcast(offsets) if broadcast_offsets else offsets, "_bucket").withColumn(
        rank_col, F.col("_offset") + F.row_number().over(w)
    )
    drop = ["_bucket", "_offset"] + ([] if with_total else ["_total"])
    return ranked.drop(*drop)


def range_rank(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row by ``order``, which must be total: rows are dealt out by range
    and sorted, and written with their place; a range's first rank is the number of rows in the
    ranges before it. The driver holds one count per range, and no window spans the rows, so
    neither a frequent prefix nor a frequent value makes a large task."""
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", PLACE_BITS).cast("int")
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part).agg(F.count(F.lit(1))).collect())  # one row per range
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    first = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    ranked = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    return ranked.withColumn(rank_col, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("_part", "_before", "_place")


def _tie_breakers(df: DataFrame, keys: list[str]) -> list:
    """The other orderable columns: with a repeated key the order stays total up to
    fully identical (interchangeable) rows, so recomputation gives the same result."""
    return [
        F.col(f.name) for f in df.schema.fields
        if f.name not in keys and f.name != "_h" and not isinstance(f.dataType, T.MapType)
    ]


def shuffle(df: DataFrame, key: str | list[str], seed: int = 42, digits: int = DEFAULT_DIGITS,
            rank_col: str = "rank", with_total: bool = False, first: int | None = None) -> DataFrame:
    """Seeded full permutation (F1): adds ``rank`` (1..n); order by it to shuffle.
    ``key`` should be unique (an id): equal keys share a hash and a bucket (ties are
    broken by the other columns)."""
    if not 1 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must be 1 to {MAX_DIGITS}")
    keys = [key] if isinstance(key, str) else list(key)
    h = hash_key(keys, seed)
    df = df.withColumn("_h", h)
    out = global_rank(
        df,
        [F.col("_h")] + [F.col(k) for k in keys] + _tie_breakers(df, keys),
        F.substring(F.col("_h"), 1, digits),
        rank_col=rank_col,
        with_total=with_total,
        first=first,
    )
    return out.drop("_h")


def sample_exact(df: DataFrame, key: str | list[str], k: int, seed: int = 42,
                 strict: bool = True, digits: int = DEFAULT_DIGITS) -> DataFrame:
    """The first ``k`` rows of the seeded permutation (F2), with their rank.

    Bucket sizes tell which hash buckets the sample can reach; only their rows (about
    ``k``, whatever the columns) are shuffled and ranked. ``strict`` fails like the
    reference's ``select(range(k))`` when k > n (one count); without it all n rows come."""
    if strict:
        n = df.count()
        if k > n:
            raise IndexError(f"sample of {k} rows asked from {n} rows")
    return shuffle(df, key, seed, digits, first=k).where(F.col("rank") <= k)


def train_val_split(df: DataFrame, key: str | list[str], val_fraction: float = 0.10,
                    seed: int = 42, split_col: str = "split") -> DataFrame:
    """Exact-size split (F3): the first ``ceil(val_fraction * n)`` rows of the seeded
    permutation are ``'val'``, the rest ``'train'``. ``n`` comes from the bucket sizes,
    so no extra pass over the data is needed."""
    ranked = shuffle(df, key, seed, with_total=True)
    n_val = F.ceil(F.col("_total") * F.lit(float(val_fraction)))
    return ranked.withColumn(
        split_col, F.when(F.col("rank") <= n_val, F.lit("val")).otherwise(F.lit("train"))
    ).drop("_total")


def n_val_rows(n: int, val_fraction: float) -> int:
    """Python twin of the split size (``ceil`` of a float product, as in the
    reference's splitter)."""
    return math.ceil(n * val_fraction)
