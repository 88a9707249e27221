"""Native tokenizer with character offsets (G1).

Tokens are runs of word characters or single other non-space characters. Offsets are
0-based code points, end exclusive. The tokenizer is a narrow (per-row) expression: one
vectorised Arrow function per batch classifies code points and cuts tokens at the changes of
class. Tokenising never needs a shuffle; token rows come from an explode of the per-row array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import posexplode_rows
from spanlake.functions.arrow_helpers import text_to_tokens
from spanlake.functions.text import TOKEN_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_array(text) -> Column:
    """``array<struct<tok:string, start:int, end:int>>`` for a text column."""
    return text_to_tokens(_c(text))


def token_strings(text) -> Column:
    """Just the token strings (no offsets, no Python)."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize_offsets(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per token: ``(id, pos, tok, start, end)``; ``pos`` is 0-based.

    The text column is dropped before the explode so token rows stay narrow.
    """
    arr = df.select(F.col(id_col), token_array(text_col).alias("_toks"))
    gen, keep = posexplode_rows("_toks", "pos", "_t")
    return arr.select(F.col(id_col), gen).where(keep).select(
        id_col,
        "pos",
        F.col("_t.tok").alias("tok"),
        F.col("_t.start").alias("start"),
        F.col("_t.end").alias("end"),
    )
