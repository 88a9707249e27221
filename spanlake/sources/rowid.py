"""Row identity and dataset previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row_id(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Positional row id (A6), to be applied straight after a scan: unique and stable
    under recomputation because file splits are deterministic; not consecutive."""
    return df.withColumn(id_col, F.monotonically_increasing_id())


def with_key_id(df: DataFrame, cols: list[str], id_col: str = "row_key") -> DataFrame:
    """Content key (A6): 128-bit ``md5`` of the key columns; equal rows share it."""
    return df.withColumn(
        id_col, F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]))
    )


def describe_dataset(df: DataFrame) -> DataFrame:
    """One row: feature names and row count (A7, E1) -- the count is a distributed
    aggregate, only this single row reaches the driver when shown."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(", ".join(df.columns)).alias("features"), "num_rows"
    )


def preview(df: DataFrame, key: str = "id", n: int = 1) -> DataFrame:
    """First ``n`` rows by key (A7): a bounded top-k, no full sort."""
    return df.orderBy(key).limit(n)
