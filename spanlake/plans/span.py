"""Span-extraction plan: examples -> windows -> logits -> best span ->
metrics, as one lazy DataFrame plan.

Shuffles: the logits sparse regroup and idf count (by window / term), the best-span
aggregation by example id, and the metric aggregation. Tokenising and windowing are
narrow. ``checkpoint_features`` cuts the lineage after windowing (reliable
checkpoint into the shared folder) for very long jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import decode, scoring, windows
from spanlake.operators.metrics import registry, squad
from spanlake.session import bucketed_table, cut_lineage


def prepare(examples: DataFrame, max_length: int = 512, stride: int = 128, n_special: int = 3,
            checkpoint_features: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Tokenise + window + label (the reference's preprocessing step)."""
    f = windows.window_features(
        examples, max_length, stride, n_special, keep=["answer_start", "answer_end", *(keep or [])],
        answer_cols=("answer_start", "answer_end"),
    )
    f = windows.align_span(f, n_special=n_special).drop("_w", "_S", "_E")  # the packed columns say it all
    return cut_lineage(f) if checkpoint_features else f


def decode_with_logits(examples: DataFrame, logits: DataFrame, max_length: int = 512, stride: int = 128,
                       n_best: int = 20, max_answer_length: int = 100) -> DataFrame:
    """Best span per example from a table of model output (id, window_no, start_logits, end_logits).
    Examples without any output are not tokenised; they and those whose windows have none
    predict the empty string."""
    some = examples.join(logits.select("id").distinct(), "id", "left_semi")
    feats = windows.window_features(some, max_length, stride, question_col=None)
    return decode.best_span(examples, decode.attach_logits(feats, logits), n_best, max_answer_length)


def decode_features(examples: DataFrame, max_length: int = 512, stride: int = 128) -> DataFrame:
    """What decoding needs of each window: its key, length, offsets and text."""
    f = windows.window_features(examples, max_length, stride, question_col=None)
    return f.select("id", "window_no", "seq_len", "offsets", "ctx_start", "ctx_text")


def at_rest(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """A table of features or logits in the shared folder, bucketed and sorted by (id, window_no): two such
    tables of as many buckets join without an exchange (D3)."""
    return bucketed_table(df, name, ["id", "window_no"], buckets)


def predict(examples: DataFrame, max_length: int = 512, stride: int = 128, n_best: int = 20,
            max_answer_length: int = 100, logits: DataFrame | None = None) -> DataFrame:
    """Best span per example; ``logits`` (id, window_no, start_logits, end_logits) from a
    model if given (joined to the windows by key), else the built-in lexical scorer,
    whose small per-example idf map is joined to the examples before windowing."""
    if logits is None:
        feats = prepare(scoring.with_question_idf(examples), max_length, stride, keep=["_qidf"])
        fl = scoring.lexical_logits(feats)
    else:
        fl = decode.attach_logits(prepare(examples, max_length, stride), logits)
    return decode.best_span(examples, fl, n_best, max_answer_length)


def run_span_task(examples: DataFrame, max_length: int = 512, stride: int = 128,
                  n_best: int = 20, max_answer_length: int = 100,
                  logits: DataFrame | None = None) -> DataFrame:
    """Per-example ``id, prediction_text, em, f1`` (scored against the example's answer)."""
    preds = predict(examples, max_length, stride, n_best, max_answer_length, logits)
    refs = examples.select("id", F.array("answer").alias("golds"))
    rows = squad.squad_rows(preds.join(refs, "id"), gold_col="golds")
    return rows.select("id", "prediction_text", "em", "f1")


def span_report(examples: DataFrame, **kw) -> DataFrame:
    """One row: EM, F1, BLEU, SacreBLEU of the span task over all examples."""
    preds = predict(examples, kw.get("max_length", 512), kw.get("stride", 128),
                    kw.get("n_best", 20), kw.get("max_answer_length", 100))
    refs = examples.select(
        "id", F.struct(F.array("answer").alias("text"), F.array("answer_start").alias("answer_start")).alias("answers")
    )
    return registry.evaluate(preds.select("id", "prediction_text"), refs, ("exact_match", "bleu"))
