"""Query -> segment plan: pairs -> drop duplicated pairs -> exact 90/10
split -> validation rows (all, or exactly k of them) -> encode -> score -> decode -> metrics.

Two stand-in generators (H2): ``nearest`` answers with the segment of the training pair whose query
shares the most idf weight (an exact search over the training split); ``echo`` is a ``mapInPandas`` scorer that
repeats the input ids, which any model with the same output schema can replace. Neither sees labels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators import dedup, encode, nearest_text, sampling, scoring
from spanlake.operators.metrics import bleu, squad
from spanlake.session import cut_lineage

_GEN_SCHEMA = T.StructType(
    [T.StructField("pair_id", T.StringType()), T.StructField("pred_ids", T.ArrayType(T.IntegerType()))]
)


def echo_query_scorer():
    """Scorer factory: returns the input ids as the generated ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair_id": pdf["pair_id"], "pred_ids": pdf["input_ids"]})

    return run


def run_pair_task(pairs: DataFrame, val_fraction: float = 0.10, k_val: int | None = 1000,
                  max_len: int = 64, seed: int = 42, scorer_factory=echo_query_scorer,
                  materialize: bool = True, generator: str = "echo") -> DataFrame:
    """Per validation pair: ``pair_id, prediction_text, em, f1, bleu``.

    ``generator`` is ``echo`` (``scorer_factory`` over the encoded queries) or ``nearest`` (the nearest
    training pair's segment, encoded and decoded like a label).

    ``k_val`` validation pairs are scored (strict, as the reference: fewer is an error), with
    None the whole validation split.

    ``materialize`` writes the tables that feed several branches (the de-duplicated
    pairs, the split, the vocabulary) into the shared folder once: Spark re-runs a
    shared subtree per branch when the branches prune different columns."""
    keep = cut_lineage if materialize else (lambda d, name=None: d)
    uniq = keep(
        dedup.drop_all_duplicates(pairs.select("pair_id", "Query", "Segment"), ["Query", "Segment"]),
        "pairs-unique",
    )
    split = keep(sampling.train_val_split(uniq, "pair_id", val_fraction, seed), "pairs-split")
    val = split.where(F.col("split") == "val").drop("rank", "split")
    if k_val is not None:
        val = keep(sampling.sample_exact(val, "pair_id", k_val, seed), "pairs-val")
    vocab = keep(encode.build_vocab(uniq, ["Query", "Segment"]), "pairs-vocab")
    if generator == "nearest":
        train = split.where(F.col("split") == "train").select("pair_id", "Query", "Segment")
        near = nearest_text.nearest_text(val.select("pair_id", "Query"), train).select("pair_id", F.coalesce("Segment", F.lit("")).alias("pred"))
        ids = encode.encode_columns(near, "pair_id", ["pred"], vocab, max_len - 2)
        gen = ids.select("pair_id", encode.frame(F.col("pred_ids"), max_len).alias("pred_ids"))
    elif generator == "echo":
        enc = encode.encode_pairs(val, vocab, "pair_id", max_len)
        gen = scoring.score(enc.select("pair_id", "input_ids"), scorer_factory, _GEN_SCHEMA)
    else:
        raise ValueError(f"unknown generator {generator!r}")
    text = encode.decode(gen, "pair_id", "pred_ids", vocab, out="prediction_text")
    scored = text.join(val.select("pair_id", "Segment"), "pair_id").withColumn(
        "golds", F.array("Segment")
    )
    rows = squad.squad_rows(scored, gold_col="golds")
    rows = bleu.with_bleu(rows, refs="golds", out="bleu")
    return rows.select("pair_id", "prediction_text", "em", "f1", "bleu")
