"""Sentence BLEU, SacreBLEU (13a tokens) and corpus BLEU.

Per row the n-gram statistics (clipped matches and totals for n = 1..4, prediction
length and closest reference length) are computed in-row with multiset arithmetic;
the sentence score is derived from them, the corpus score from their sums (one
partially pre-aggregated ``groupBy``).

Semantics (no smoothing, uniform weights): 0 if any clipped count is 0 -- so an exact
match shorter than 4 tokens scores 0 -- else ``bp * exp(mean(log p_n))`` with
``bp = 1`` when the prediction is longer than the reference, else
``exp(1 - ref_len / pred_len)``. Several references: per n-gram the largest count,
and the reference length closest to the prediction (first on ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.bags import counted, let, max_union, runs_overlap
from spanlake.functions.text import ngrams, tokens_13a, ws_split

MAX_N = 4  # fixed value: BLEU-4


def _ngram_runs(n: int):
    return lambda r: counted(ngrams(r, n))


def bleu_stats(pred: Column, refs: Column, tokenizer=ws_split, max_n: int = MAX_N) -> Column:
    """``struct<num array<int>, den array<int>, pred_len int, ref_len int>``;
    ``refs`` is an array of reference strings."""

    def with_tokens(p, rt):
        nums = F.array(*[
            runs_overlap(
                counted(ngrams(p, n)),
                # one reference (the usual case) needs no max-union
                F.when(F.size(rt) == 1, counted(ngrams(F.get(rt, 0), n))).otherwise(
                    max_union(F.transform(rt, _ngram_runs(n)))
                ),
            )
            for n in range(1, max_n + 1)
        ])
        dens = F.array(*[F.greatest(F.size(p) - (n - 1), F.lit(0)) for n in range(1, max_n + 1)])
        closest = F.array_min(
            F.transform(
                rt,
                lambda r, i: F.struct(
                    F.abs(F.size(r) - F.size(p)).alias("d"), i.alias("i"), F.size(r).alias("len")
                ),
            )
        )["len"]
        return F.struct(
            nums.alias("num"), dens.alias("den"), F.size(p).alias("pred_len"),
            F.coalesce(closest, F.lit(0)).alias("ref_len"),
        )

    return let(
        tokenizer(pred),
        lambda p: let(F.transform(refs, lambda r: tokenizer(r)), lambda rt: with_tokens(p, rt)),
    )


def bleu_from(num: Column, den: Column, pred_len: Column, ref_len: Column, max_n: int = MAX_N) -> Column:
    """BLEU from (possibly summed) statistics."""
    logs = [
        F.log(F.try_divide(F.get(num, i).cast("double"), F.get(den, i).cast("double")))
        for i in range(max_n)
    ]
    geo = F.exp(sum(logs[1:], logs[0]) / F.lit(float(max_n)))
    bp = F.when(pred_len > ref_len, F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.try_divide(ref_len.cast("double"), pred_len.cast("double")))
    )
    zero = F.array_min(num) <= 0
    return F.when(zero | (pred_len <= 0), F.lit(0.0)).otherwise(bp * geo)


def with_bleu(df: DataFrame, pred: str = "prediction_text", refs: str = "refs",
              out: str = "bleu", sacre: bool = False) -> DataFrame:
    """Adds the row's n-gram statistics (``<out>_stats``) and its sentence score."""
    tok = tokens_13a if sacre else ws_split
    st = f"{out}_stats"
    df = df.withColumn(st, bleu_stats(F.col(pred), F.col(refs), tok))
    return df.withColumn(
        out, bleu_from(F.col(f"{st}.num"), F.col(f"{st}.den"), F.col(f"{st}.pred_len"), F.col(f"{st}.ref_len"))
    )


def corpus_bleu(rows: DataFrame, stats: str = "bleu_stats", by: list[str] | None = None,
                out: str = "corpus_bleu", max_n: int = MAX_N) -> DataFrame:
    """Counts summed over rows before the ratio."""
    aggs = [F.sum(F.get(F.col(f"{stats}.num"), i)).alias(f"_num{i}") for i in range(max_n)]
    aggs += [F.sum(F.get(F.col(f"{stats}.den"), i)).alias(f"_den{i}") for i in range(max_n)]
    aggs += [F.sum(f"{stats}.pred_len").alias("_pl"), F.sum(f"{stats}.ref_len").alias("_rl")]
    g = rows.groupBy(*(by or [])).agg(*aggs)
    num = F.array(*[F.col(f"_num{i}") for i in range(max_n)])
    den = F.array(*[F.col(f"_den{i}") for i in range(max_n)])
    return g.select(*(by or []), bleu_from(num, den, F.col("_pl"), F.col("_rl"), max_n).alias(out))
