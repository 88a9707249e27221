"""Nested QA documents -> flat examples and reference shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import strip_text

NA_ANSWER = "NA"  # fixed value: answer text for a question without answers


def flatten_qa(nested: DataFrame) -> DataFrame:
    """``data[] -> paragraphs[] -> qas[]`` to one row per question (B2).

    ``answer`` is the first answer's text or ``'NA'`` (B3); ``answer_start`` and
    ``answer_end = answer_start + len(answer)`` (B4) are NULL for unanswerable items.
    Three generator steps in one stage, no shuffle.
    """
    d = nested.select(F.explode("data").alias("d"))
    p = d.select(F.explode("d.paragraphs").alias("p"))
    q = p.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("qa"))
    first = F.get(F.col("qa.answers"), 0)
    return q.select(
        F.col("qa.question").alias("question"),
        F.coalesce(first["text"], F.lit(NA_ANSWER)).alias("answer"),
        first["answer_start"].alias("answer_start"),
        (first["answer_start"] + F.length(first["text"])).alias("answer_end"),
        "context",
        F.col("qa.id").alias("id"),
    )


def strip_questions(df: DataFrame, col: str = "question") -> DataFrame:
    """Python-``strip`` semantics for the question column."""
    return df.withColumn(col, strip_text(col))


def to_references(examples: DataFrame) -> DataFrame:
    """Nested reference struct (B8): ``id, answers{text[], answer_start[]}``."""
    return examples.select(
        "id",
        F.struct(
            F.array(F.col("answer")).alias("text"),
            F.array(F.col("answer_start")).alias("answer_start"),
        ).alias("answers"),
    )


def to_pair_references(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Flat references for query/segment pairs (B9): ``key, Query, Segment``."""
    return pairs.select(key, "Query", "Segment")
