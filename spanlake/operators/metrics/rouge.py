"""ROUGE-1, ROUGE-2 (in-row multiset overlap) and ROUGE-L (Arrow-batched LCS)
precision / recall / F, and their macro averages (E9-E11).

Tokens: lower case, anything but ``[a-z0-9]`` separates. Precision = hits / predicted
units, recall = hits / reference units, F = 2PR/(P+R); all 0 when either side is empty
or nothing matches. Only the first reference is used, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrow_helpers import lcs_udf
from spanlake.functions.bags import bag_overlap, let
from spanlake.functions.text import ngrams, rouge_tokens

ROUGE_KEYS = ("rouge1", "rouge2", "rougeL")  # fixed value: reported keys


def prf(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """``struct<precision, recall, fmeasure>`` from hits and both unit counts (inputs
    are bound once, so an overlap expression is never evaluated twice)."""

    def body(t):
        h, np_, nr = t["h"], t["np"], t["nr"]
        p = F.try_divide(h.cast("double"), F.greatest(np_, F.lit(1)).cast("double"))
        r = F.try_divide(h.cast("double"), F.greatest(nr, F.lit(1)).cast("double"))
        empty = (np_ <= 0) | (nr <= 0) | (h <= 0)
        zero = F.lit(0.0)
        return let(
            F.struct(p.alias("p"), r.alias("r"), empty.alias("e")),
            lambda q: F.struct(
                F.when(q["e"], zero).otherwise(q["p"]).alias("precision"),
                F.when(q["e"], zero).otherwise(q["r"]).alias("recall"),
                F.when(q["e"], zero)
                .otherwise(F.try_divide(2 * q["p"] * q["r"], q["p"] + q["r"]))
                .alias("fmeasure"),
            ),
        )

    return let(F.struct(hits.alias("h"), n_pred.alias("np"), n_ref.alias("nr")), body)


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    def score(p, r):
        return let(
            ngrams(p, n),
            lambda gp: let(ngrams(r, n), lambda gr: prf(bag_overlap(gp, gr), F.size(gp), F.size(gr))),
        )

    return let(rouge_tokens(pred), lambda p: let(rouge_tokens(ref), lambda r: score(p, r)))


def with_rouge(df: DataFrame, pred: str = "prediction_text", ref: str = "reference",
               lcs: bool = True) -> DataFrame:
    """Adds ``rouge1``, ``rouge2`` and (if ``lcs``) ``rougeL`` struct columns."""
    out = df.withColumn("rouge1", rouge_n(F.col(pred), F.col(ref), 1)).withColumn(
        "rouge2", rouge_n(F.col(pred), F.col(ref), 2)
    )
    if lcs:
        out = (
            out.withColumn("_rp", rouge_tokens(F.col(pred)))
            .withColumn("_rr", rouge_tokens(F.col(ref)))
            .withColumn("_lcs", lcs_udf(F.col("_rp"), F.col("_rr")))
            .withColumn("rougeL", prf(F.col("_lcs"), F.size("_rp"), F.size("_rr")))
            .drop("_rp", "_rr", "_lcs")
        )
    return out

