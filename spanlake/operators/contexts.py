"""Windows of contexts that many questions share (G1, G3 over distinct contexts).

In nested QA documents a paragraph's questions repeat its context. Here a context is known by its
content (a 256-bit digest), and each distinct one is tokenised once, where its copies meet; the
questions, which travel without their context, are joined to the tokens there, and windows
are cut behind the join. Contexts that occur in many paragraphs or documents, as copies do, are one context.

Texts move once to meet their copies, and the token table once to meet the questions. (Joining questions to
finished windows instead was measured: windows of four question lengths are several times the
tokens, and all of them would be shuffled.) A context with very many questions is many rows
on the question side of an equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.tokens import token_array
from spanlake.operators.windows import cut_windows, pack_windows, question_tokens


def context_key(context: str | Column = "context") -> Column:
    """Digest of a context's content; null counts as empty."""
    c = F.col(context) if isinstance(context, str) else context
    return F.unhex(F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256))


def distinct_contexts(examples: DataFrame, context_col: str = "context") -> DataFrame:
    """``ctx_key, context``: each different context once (copies are dropped before the shuffle)."""
    rows = examples.select(context_key(context_col).alias("ctx_key"), F.coalesce(F.col(context_col), F.lit("")).alias("context"))
    return rows.groupBy("ctx_key").agg(F.any_value("context").alias("context"))


def context_tokens(contexts: DataFrame) -> DataFrame:
    """``ctx_key, _context, _ctx``: the token table, keyed by content."""
    return contexts.select("ctx_key", F.col("context").alias("_context"), token_array("context").alias("_ctx"))


def shared_window_features(
    questions: DataFrame,
    contexts: DataFrame,
    max_length: int = 512,
    stride: int = 128,
    n_special: int = 3,
    id_col: str = "id",
    question_col: str = "question",
    keep: list[str] | None = None,
    pad: bool = True,
) -> DataFrame:
    """The rows of ``window_features`` for ``questions`` (id, question, ctx_key, keep) over ``contexts``
    (ctx_key, context; one row per key). A question whose context is missing gives no row."""
    keep = list(keep or [])
    q = questions.select(F.col(id_col).alias("id"), "ctx_key", *keep, question_tokens(question_col).alias("_q"))
    sized = q.withColumn("q_len", F.size("_q")).join(context_tokens(contexts).withColumnRenamed("ctx_key", "_key"), F.col("ctx_key") == F.col("_key"))
    win = cut_windows(sized, ["id", *keep, "_q", "q_len"], max_length, stride, n_special)
    return pack_windows(win, ["id", "window_no", *keep], max_length, n_special, pad)
