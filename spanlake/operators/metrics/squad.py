"""SQuAD exact match and token F1 (G0, E3, E4) with prediction/reference pairing
by key (D5) and missing predictions scoring 0 (D6).

Per example the score is the maximum over its gold answers; the run score is the
mean times 100. All row-level work is in-row array arithmetic; the only shuffle is
the key join and the final (partially pre-aggregated) average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.bags import bag_overlap, let
from spanlake.functions.text import squad_tokens


def pair_up(preds: DataFrame, refs: DataFrame, key: str = "id", how: str = "left") -> DataFrame:
    """References joined to predictions by key. ``how='left'`` keeps references without a
    prediction: their prediction is the empty string and ``matched`` is false, which scores
    0 whatever the gold text normalises to (D5/D6)."""
    joined = refs.join(preds.withColumn("matched", F.lit(True)), key, how)
    return joined.withColumn("prediction_text", F.coalesce(F.col("prediction_text"), F.lit(""))).withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def f1_from_counts(same: Column, n_pred: Column, n_gold: Column) -> Column:
    """Token F1 from the overlap size and both token counts (0 when nothing matches);
    the overlap is bound once."""

    def body(t):
        prec = F.try_divide(t["s"].cast("double"), t["np"])
        rec = F.try_divide(t["s"].cast("double"), t["ng"])
        return F.when(t["s"] == 0, F.lit(0.0)).otherwise(
            let(F.struct(prec.alias("p"), rec.alias("r")),
                lambda q: F.try_divide(2 * q["p"] * q["r"], q["p"] + q["r"]))
        )

    return let(F.struct(same.alias("s"), n_pred.alias("np"), n_gold.alias("ng")), body)


def squad_rows(pairs: DataFrame, gold_col: str = "answers.text") -> DataFrame:
    """Per-row ``em`` and ``f1`` (0/1 and 0..1), maximum over an array of gold texts."""
    golds = F.col(gold_col)
    counts = F.col("matched") if "matched" in pairs.columns else F.lit(True)

    def per_gold(pt):
        return F.transform(
            golds,
            lambda g: let(
                squad_tokens(g),
                lambda gt: F.struct(
                    (F.array_join(pt, " ") == F.array_join(gt, " ")).cast("double").alias("em"),
                    f1_from_counts(bag_overlap(pt, gt), F.size(pt), F.size(gt)).alias("f1"),
                ),
            ),
        )

    return (
        pairs.withColumn("_s", let(squad_tokens(F.col("prediction_text")), per_gold))
        .withColumn("em", F.when(counts, F.coalesce(F.array_max(F.col("_s.em")), F.lit(0.0))).otherwise(0.0))
        .withColumn("f1", F.when(counts, F.coalesce(F.array_max(F.col("_s.f1")), F.lit(0.0))).otherwise(0.0))
        .drop("_s")
    )

