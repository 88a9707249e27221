"""Start/end logits -> best answer span per example.

Per window everything happens inside the row: top-n start and end indices (F5), the
candidates (D4) that pass offsets and length (C1, C2), scored by ``start + end`` in float
(F8) and searched by bounds for the window's best. Across windows one
aggregation by example id (partially pre-aggregated, so a hot id cannot pile up in
one task) keeps the first maximum (F6). Examples without any window get ``''`` (F7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrow_helpers import best_candidates


def attach_logits(features: DataFrame, logits: DataFrame, keys=("id", "window_no")) -> DataFrame:
    """Join logits to features by key, not by position (D3)."""
    return features.join(logits, list(keys))


def group_features(features: DataFrame, cols=("window_no",)) -> DataFrame:
    """Features collected per example (E2): ``id, windows`` ordered by window number.
    A group is bounded by one context's window count."""
    return features.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("windows")
    )


def window_best(feat_logits: DataFrame, n_best: int = 20, max_answer_length: int = 100) -> DataFrame:
    """Best candidate of each window: ``id, window_no, best`` where ``best`` is the
    ordering key ``{score, neg_window, neg_si, neg_ei, start_char, end_char}`` (NULL
    when no candidate survives). The window number is inside the key so one ``max``
    per example picks the first maximum across windows.

    Candidates come from an Arrow function over whole batches (``best_candidates``): starts in
    falling order of their logit, each with the best of its admissible ends; a window is done
    when its next start cannot reach its best score any more. A NaN logit is no candidate."""
    b = best_candidates(n_best, max_answer_length)("start_logits", "end_logits", F.col("offsets.start"), F.col("offsets.end"))
    # the span text comes from the window's own text: one substring per window
    text = F.substring(F.col("ctx_text"), F.col("_b.start_char") - F.col("ctx_start") + 1, F.col("_b.end_char") - F.col("_b.start_char"))
    best = F.when(F.col("_b").isNull(), F.lit(None)).otherwise(
        F.struct(
            F.col("_b.score").alias("score"), (-F.col("window_no")).alias("neg_w"), (-F.col("_b.si")).alias("neg_si"), (-F.col("_b.ei")).alias("neg_ei"),
            F.col("_b.start_char").alias("start_char"), F.col("_b.end_char").alias("end_char"), text.alias("text"),
        )
    )
    scored = feat_logits.select("id", "window_no", "ctx_text", "ctx_start", b.alias("_b"))
    return scored.select("id", "window_no", best.alias("best"))


def best_span(examples: DataFrame, feat_logits: DataFrame, n_best: int = 20,
              max_answer_length: int = 100) -> DataFrame:
    """``id, prediction_text, start_char, end_char, score`` for every example.

    Examples without a window (or without a surviving candidate) join the aggregation
    as a NULL key, so every example gets a row without joining the contexts back: the
    only shuffle is the (partially pre-aggregated) ``max`` by id, on small rows.
    """
    # ``max`` skips NULL keys; referencing ``best`` once keeps the candidate grid from
    # being evaluated more than once per window.
    wb = window_best(feat_logits, n_best, max_answer_length).select("id", "best")
    key_type = wb.schema["best"].dataType
    ids = examples.select("id", F.lit(None).cast(key_type).alias("best"))
    per_ex = wb.unionByName(ids).groupBy("id").agg(F.max("best").alias("b"))
    return per_ex.select(
        "id",
        F.coalesce(F.col("b.text"), F.lit("")).alias("prediction_text"),
        F.col("b.start_char").alias("start_char"),
        F.col("b.end_char").alias("end_char"),
        F.col("b.score").alias("score"),
    )
