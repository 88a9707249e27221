"""Model-output contract (H1, H2) and a built-in lexical scorer (H3).

H1/H2: a user function runs over Arrow batches with ``mapInPandas``; it is created once
per task (``scorer_factory``), never per row, and its output is joined back by key.
H3: a relational stand-in for the neural model -- each context token whose lower-case
form appears in the question gets its inverse document frequency as start and end
logit; other context tokens get 0, non-context positions ``MASKED``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.operators.tokens import token_strings

MASKED = -10000.0  # fixed value: logit for positions outside the context


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Batched 1->N map over Arrow batches (H1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def score(df: DataFrame, scorer_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
          schema) -> DataFrame:
    """Batch scoring (H2): ``scorer_factory()`` is called once per task (load a model
    there), its result maps each Arrow batch to output rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(run, schema)


def idf_table(examples: DataFrame, terms: DataFrame, id_col: str = "id",
              context_col: str = "context") -> DataFrame:
    """``term, idf`` with ``idf = ln((N + 1) / (df + 1)) + 1`` over examples' contexts,
    for the given terms only (semi-join before the count keeps the shuffle small)."""
    gen, keep = explode_rows(F.array_distinct(F.transform(token_strings(context_col), F.lower)), "term")
    ctx_terms = examples.select(id_col, gen).where(keep)
    dfreq = (
        ctx_terms.join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    n = examples.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    return dfreq.select("term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def question_terms(examples: DataFrame, question_col: str = "question", id_col: str = "id") -> DataFrame:
    """``id, term``: distinct lower-case question tokens of each example."""
    gen, keep = explode_rows(F.array_distinct(F.transform(token_strings(question_col), F.lower)), "term")
    return examples.select(F.col(id_col).alias("id"), gen).where(keep)


def with_question_idf(examples: DataFrame, id_col: str = "id", question_col: str = "question",
                      context_col: str = "context") -> DataFrame:
    """Adds ``_qidf``, a map from each question term of the example to its idf.

    The map is small (one question's terms), so the later per-token lookup happens
    inside the window rows: no join ever touches the windowed features. The idf count
    is semi-joined to question terms before it shuffles."""
    qt = question_terms(examples, question_col, id_col)
    idf = idf_table(examples, qt.select("term").distinct(), id_col, context_col)
    qmap = qt.join(idf, "term").groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("_qidf")
    )
    return examples.join(qmap.withColumnRenamed("id", id_col), id_col, "left")


def _weights(qidf_col: str = "_qidf"):
    """Per position: idf of a context token that is a question term, 0 for other
    context tokens, NULL outside the context."""
    return F.transform(
        F.arrays_zip("tokens", "seq_ids"),
        lambda z: F.when(
            z["seq_ids"] == 1,
            F.coalesce(F.try_element_at(F.col(qidf_col), F.lower(z["tokens"])), F.lit(0.0)),
        ),
    )


def lexical_hits(features: DataFrame, qidf_col: str = "_qidf") -> DataFrame:
    """``id, window_no, pos, weight`` for every context position whose token is a
    question term (the sparse form of the H3 logits); in-row, then one explode."""
    marked = F.filter(
        F.transform(_weights(qidf_col), lambda w, i: F.struct(i.alias("pos"), w.alias("weight"))),
        lambda h: h["weight"] > 0,
    )
    gen, keep = explode_rows(marked, "_h")
    return features.select("id", "window_no", gen).where(keep).select(
        "id", "window_no", F.col("_h.pos").alias("pos"), F.col("_h.weight").alias("weight")
    )


def lexical_logits(features: DataFrame, qidf_col: str = "_qidf") -> DataFrame:
    """Features with dense ``start_logits`` / ``end_logits`` arrays (H3), computed in
    the window's row from the example's ``_qidf`` map."""
    logits = F.transform(
        _weights(qidf_col), lambda w: F.coalesce(w, F.lit(MASKED)).cast("float")
    )
    return features.withColumn("start_logits", logits).withColumn("end_logits", F.col("start_logits"))
