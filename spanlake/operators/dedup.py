"""Drop every member of a duplicated group (C4, ``drop_duplicates(keep=False)``).

Two passes. First only 128-bit hashes of the keys are counted (narrow rows, map-side partial
counts, so a hot key costs one row a task). A row whose hash occurs once is unique: it passes
without its keys ever being grouped, and long texts of unique rows are not shuffled. Rows of
repeated hashes, the only ones that can be duplicates, are grouped by their full keys, which tells
hash collisions from copies. NULLs compare equal, as in the reference.

The repeated hashes are broadcast up to ``BROADCAST_HASHES`` of them (counted first); beyond that both
sides meet by hash, with the columns that the result needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

#: Repeated hashes (16 bytes each) that are broadcast at most.
BROADCAST_HASHES = 500_000


def drop_all_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows whose ``cols`` values occur exactly once (all columns by default)."""
    keys = list(cols or df.columns)
    others = [c for c in df.columns if c not in keys]
    aggs = [F.count(F.lit(1)).alias("_n")]
    if others:
        aggs.append(F.any_value(F.struct(*others)).alias("_row"))
    hashes = [F.xxhash64(*keys).alias("_h1"), F.xxhash64(F.lit(1), *keys).alias("_h2")]
    rows = df.select("*", *hashes)
    many = cut_lineage(rows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h1", "_h2"), "repeated-hashes")
    if many.count() <= BROADCAST_HASHES:
        many = F.broadcast(many)
    alone = rows.join(many, ["_h1", "_h2"], "left_anti").select(*df.columns)
    g = rows.join(many, ["_h1", "_h2"], "left_semi").groupBy("_h1", *keys).agg(*aggs).where(F.col("_n") == 1)
    sel = [F.col(k) for k in keys] + [F.col(f"_row.{c}").alias(c) for c in others]
    return alone.unionByName(g.select(*sel).select(*df.columns))
