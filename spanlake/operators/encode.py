"""Vocabulary, fixed-length encoding, batch padding and decoding.

Token -> id lookups are relational: token rows join the vocabulary (broadcast when
the planner or AQE sees it is small, else a skew-aware sort-merge join) and regroup
per row with an ordered ``collect_list``; a row's list is bounded by its own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows, pad_array
from spanlake.operators.sampling import range_rank, shuffle
from spanlake.operators.tokens import token_strings

# fixed values: special tokens and their ids, label padding
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
LABEL_PAD = -100


def build_vocab(texts: DataFrame, cols: list[str]) -> DataFrame:
    """``tok, cnt, id`` over all tokens of ``cols``; ids after the specials, by count
    (desc) then token. Counting is partially pre-aggregated; the rank is exact and
    distributed by range."""
    gen, keep = explode_rows(F.flatten(F.array(*[token_strings(c) for c in cols])), "tok")
    toks = texts.select(gen).where(keep)
    counts = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = range_rank(counts, [F.col("cnt").desc(), F.col("tok")], "_r")
    return ranked.select("tok", "cnt", (F.col("_r") - 1 + len(SPECIALS)).cast("int").alias("id"))


def encode_columns(df: DataFrame, key: str, cols: list[str], vocab: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``key, <col>_ids...``: vocabulary ids of each column's tokens (unknown -> UNK), the first
    ``max_tokens`` if given (cut before any token is shuffled).

    One explode over all columns, one vocabulary join, one regroup by row: rows of equal
    key stay apart, and the outer explode carries rows without tokens through, so the
    input is evaluated once."""
    part = [F.slice(token_strings(c), 1, max_tokens) if max_tokens else token_strings(c) for c in cols]
    sides = F.array(*[F.struct(F.lit(i).alias("side"), t.alias("toks")) for i, t in enumerate(part)])
    gen, keep = explode_rows(sides, "_s")
    numbered = df.withColumn("_row", F.monotonically_increasing_id())  # before the generator multiplies rows
    per_side = numbered.select("_row", key, gen).where(keep).select("_row", key, "_s.side", "_s.toks")
    rows = per_side.select("_row", key, "side", F.posexplode_outer("toks").alias("pos", "tok"))
    ids = rows.join(vocab.select("tok", "id"), "tok", "left").select(
        "_row", key, "side", "pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")
    )
    entry = F.struct("pos", "id")
    grouped = ids.groupBy("_row", key).agg(*[
        F.array_sort(F.collect_list(F.when((F.col("side") == i) & F.col("pos").isNotNull(), entry))).alias(f"_p{i}")
        for i in range(len(cols))
    ])
    return grouped.select(key, *[
        F.transform(f"_p{i}", lambda x: x["id"]).alias(f"{c}_ids") for i, c in enumerate(cols)
    ])


def frame(ids, max_len: int | None):
    """``[CLS] ids [SEP]``, truncated so the whole fits in ``max_len``."""
    body = F.slice(ids, 1, max_len - 2) if max_len else ids
    return F.concat(F.array(F.lit(BOS_ID)), body, F.array(F.lit(EOS_ID)))


def encode_pairs(pairs: DataFrame, vocab: DataFrame, key: str = "pair_id", max_len: int | None = 64,
                 pad: bool = True, src: str = "Query", tgt: str = "Segment") -> DataFrame:
    """``key, input_ids, attention_mask, labels`` (G9): truncate and pad both sides
    to ``max_len``; mask is 1 on real tokens."""
    j = encode_columns(pairs, key, [src, tgt], vocab, max_len - 2 if max_len else None)
    inp, lab = frame(F.col(f"{src}_ids"), max_len), frame(F.col(f"{tgt}_ids"), max_len)
    out = j.select(key, inp.alias("input_ids"), lab.alias("labels"))
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if pad and max_len:
        out = out.select(
            key,
            pad_array("input_ids", max_len, PAD_ID).alias("input_ids"),
            pad_array("attention_mask", max_len, 0).alias("attention_mask"),
            pad_array("labels", max_len, PAD_ID).alias("labels"),
        )
    return out.select(key, "input_ids", "attention_mask", "labels")


def batch_pad(encoded: DataFrame, key: str = "pair_id", batch_size: int = 16, seed: int = 42) -> DataFrame:
    """Seeded batches of ``batch_size`` padded to their longest member (G10); labels
    padded with -100. A batch is a bounded group, so the per-batch max is a window."""
    r = shuffle(encoded, key, seed).withColumn("batch", ((F.col("rank") - 1) / batch_size).cast("long"))
    w = Window.partitionBy("batch")
    r = r.withColumn("_L", F.max(F.greatest(F.size("input_ids"), F.size("labels"))).over(w))
    return r.select(
        key,
        "batch",
        "rank",
        pad_array("input_ids", F.col("_L"), PAD_ID).alias("input_ids"),
        pad_array("attention_mask", F.col("_L"), 0).alias("attention_mask"),
        pad_array("labels", F.col("_L"), LABEL_PAD).alias("labels"),
    )


def decode(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out: str = "text",
           skip_special: bool = True) -> DataFrame:
    """ids -> text joined by spaces (G11), dropping specials and label padding (C5). The input is
    evaluated once (it may be a scorer): specials go inside the array, and the outer explode
    keeps rows that are left without ids; rows of equal key stay apart."""
    ids = F.col(ids_col)
    if skip_special:
        ids = F.filter(ids, lambda i: i >= len(SPECIALS))
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select("_row", key, F.posexplode_outer(ids).alias("pos", "id"))
    named = rows.join(vocab.select("id", "tok"), "id", "left").select(
        "_row", key, "pos", F.coalesce("tok", F.lit(SPECIALS[UNK_ID])).alias("tok")
    )
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "tok"))
    grouped = named.groupBy("_row", key).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    return grouped.select(
        key, F.coalesce(F.array_join(F.transform("_p", lambda x: x["tok"]), " "), F.lit("")).alias(out)
    )
