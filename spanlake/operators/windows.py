"""Question + context packing, sliding windows and span labels.

One example becomes 1..N window rows through ``explode(sequence(...))``: the parent id
and answer columns ride along (D1/G7), so no join is needed to map a window back to its
example. Tokens stay in per-row arrays; only the window explode multiplies rows.

Layout of a packed sequence with ``n_special`` specials (default 3):
``[CLS] question [SEP]*(n_special-2) context-window [SEP]`` then padding to
``max_length``. Label positions count this whole sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.bags import let
from spanlake.functions.text import strip_text
from spanlake.operators.tokens import token_array

# fixed values: special token strings
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"

def window_count(n: Column, cap: Column, step: Column) -> Column:
    """1 if the context fits, else ``ceil((n - cap) / step) + 1``."""
    return F.when(n <= cap, F.lit(1)).otherwise(
        F.ceil((n - cap).cast("double") / step).cast("int") + 1
    )


def question_tokens(question_col: str | None, tokens: Callable[[Column | str], Column] = token_array) -> Column:
    """Tokens of the stripped question (none without a question column)."""
    if question_col is None:
        return F.array().cast("array<struct<tok:string,start:int,end:int>>")
    return tokens(F.coalesce(strip_text(question_col), F.lit("")))


def window_features(
    examples: DataFrame,
    max_length: int = 512,
    stride: int = 128,
    n_special: int = 3,
    id_col: str = "id",
    question_col: str | None = "question",
    context_col: str = "context",
    keep: list[str] | None = None,
    pad: bool = True,
    answer_cols: tuple[str, str] | None = None,
    tokens: Callable[[Column | str], Column] = token_array,
) -> DataFrame:
    """Tokenise question and context, cut the context into overlapping windows and
    build the packed sequence of each window (G1-G5, G7, B7).

    With ``answer_cols`` (start, end character columns) the answer's token bounds in
    the whole context are computed once per example (``_S``, ``_E``) so that
    :func:`align_span` needs no per-window scan.

    Output: ``id, window_no, <keep>, q_len, ctx_first, n_ctx, seq_len,
    ctx_index_first, ctx_index_last, ctx_start, ctx_end, ctx_text, tokens, seq_ids,
    offsets, _w``. ``ctx_text`` is the context
    between the window's first and last token, so later steps never need the whole
    context again. Windows are cut in two steps, blocks of windows and then windows, so
    that no row holds more than a block (about twice its share of the context).

    ``tokens`` is the tokenizer, a function from a text column to token structs (``tok``, ``start``, ``end``):
    words by default, ``functions.subwords.subword_array`` for sub-words.

    Every example comes out: a NULL question or context counts as empty, and an example
    whose question leaves no room for a step (``cap <= stride``) gives one row flagged
    ``too_long`` without context tokens.
    """
    keep = list(keep or [])
    base = examples.select(
        F.col(id_col).alias("id"),
        *keep,
        question_tokens(question_col, tokens).alias("_q"),
        tokens(F.coalesce(F.col(context_col), F.lit(""))).alias("_ctx"),
        F.coalesce(F.col(context_col), F.lit("")).alias("_context"),
    )
    bounds = []
    if answer_cols:
        sc, ec = F.col(answer_cols[0]), F.col(answer_cols[1])
        # offsets rise: last token starting at/before sc, first token ending at/after ec
        bounds = [
            (F.size(F.filter("_ctx", lambda t: t["start"] <= sc)) - 1).alias("_S"),
            (F.size("_ctx") - F.size(F.filter("_ctx", lambda t: t["end"] >= ec))).alias("_E"),
        ]
    extra = ["_S", "_E"] if answer_cols else []
    sized = base.select("*", F.size("_q").alias("q_len"), *bounds)
    win = cut_windows(sized, ["id", *keep, *extra, "_q", "q_len"], max_length, stride, n_special)
    return pack_windows(win, ["id", "window_no", *keep, *extra], max_length, n_special, pad)


def cut_windows(sized: DataFrame, base_cols: list[str], max_length: int, stride: int, n_special: int = 3) -> DataFrame:
    """Rows with context tokens (``_ctx``), context (``_context``) and ``q_len`` to one row per window:
    ``base_cols``, too_long, window_no, ctx_first, _w (its tokens), ctx_start, ctx_end, ctx_text."""
    cap = F.lit(max_length - n_special) - F.col("q_len")
    step = cap - F.lit(stride)
    sized = sized.select("*", cap.alias("_cap"), step.alias("_step"), F.size("_ctx").alias("_n")).select("*", (F.col("_step") <= 0).alias("too_long"))
    fits = ~F.col("too_long")
    # windows in a block: as many as make its steps cover one window's capacity
    per = F.when(fits, F.greatest(F.lit(1), F.ceil(F.col("_cap") / F.col("_step")).cast("int"))).otherwise(1)
    n_win = F.when(fits, window_count(F.col("_n"), F.col("_cap"), F.col("_step"))).otherwise(1)
    sized = sized.select("*", per.alias("_per"), n_win.alias("_n_win"))

    def cut(tokens, text, text_from, name):
        """Tokens with the text between the first and the last of them (offsets stay those of the context)."""
        a, b = F.get(tokens, 0)["start"], F.get(tokens, F.size(tokens) - 1)["end"]
        return [tokens.alias(name), a.alias("ctx_start"), b.alias("ctx_end"),
                F.substring(text, a - text_from + 1, b - a).alias("ctx_text")]

    def one_block(b):
        first = b * F.col("_per")
        here = F.least(F.col("_per"), F.col("_n_win") - first)
        span = F.when(fits, (here - 1) * F.col("_step") + F.col("_cap")).otherwise(0)
        return let(
            F.slice("_ctx", F.when(fits, first * F.col("_step")).otherwise(0) + 1, span),
            lambda w: F.struct(first.alias("first"), here.alias("here"), *cut(w, F.col("_context"), F.lit(0), "tokens")),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_n_win") / F.col("_per")).cast("int") - 1), one_block)
    gen, keep_row = explode_rows(blocks, "_b")
    base_cols = [*base_cols, "too_long"]
    blocked = sized.select(*base_cols, "_cap", "_step", gen).where(keep_row)

    def one_window(k):
        return let(
            F.slice(
                F.col("_b.tokens"), F.when(fits, k * F.col("_step")).otherwise(0) + 1, F.when(fits, F.col("_cap")).otherwise(0)),
            lambda w: F.struct(
                (F.col("_b.first") + k).alias("window_no"),
                F.when(fits, (F.col("_b.first") + k) * F.col("_step")).otherwise(0).alias("ctx_first"),
                *cut(w, F.col("_b.ctx_text"), F.col("_b.ctx_start"), "_w"),
            ),
        )

    gen, keep_row = explode_rows(F.transform(F.sequence(F.lit(0), F.col("_b.here") - 1), one_window), "_win")
    return blocked.select(*base_cols, gen).where(keep_row).select(*base_cols, "_win.*")


def pack_windows(win: DataFrame, first_cols: list[str], max_length: int, n_special: int = 3, pad: bool = True) -> DataFrame:
    """Windows with question tokens (``_q``) to packed sequences, from native array expressions (field
    extraction, concat, repeat): ``[CLS] question [SEP]*(n_special-2) window [SEP] [PAD]*``."""
    m = F.size("_w")
    n_sep = n_special - 2
    seq_len = F.col("q_len") + F.lit(n_special) + m
    n_pad = F.greatest(F.lit(max_length) - seq_len, F.lit(0)) if pad else F.lit(0)
    null_int = F.lit(None).cast("int")
    null_off = F.lit(None).cast("struct<start:int,end:int>")
    tokens = F.concat(
        F.array(F.lit(CLS)), F.col("_q.tok"), F.array_repeat(F.lit(SEP), n_sep), F.col("_w.tok"),
        F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), n_pad),
    )
    seq_ids = F.concat(
        F.array(null_int), F.array_repeat(F.lit(0), F.col("q_len")), F.array_repeat(null_int, n_sep),
        F.array_repeat(F.lit(1), m), F.array(null_int), F.array_repeat(null_int, n_pad),
    )
    offsets = F.concat(
        F.array_repeat(null_off, F.col("q_len") + n_sep + 1),
        F.arrays_zip(F.col("_w.start"), F.col("_w.end")).cast("array<struct<start:int,end:int>>"),
        F.array_repeat(null_off, n_pad + 1),
    )
    return win.select(
        *first_cols,
        "q_len",
        "ctx_first",
        m.alias("n_ctx"),
        seq_len.alias("seq_len"),
        # first / last context position in the packed sequence
        (F.col("q_len") + F.lit(n_special - 1)).alias("ctx_index_first"),
        (F.col("q_len") + F.lit(n_special - 2) + m).alias("ctx_index_last"),
        "ctx_start",
        "ctx_end",
        "ctx_text",
        "too_long",
        tokens.alias("tokens"),
        seq_ids.alias("seq_ids"),
        offsets.alias("offsets"),
        "_w",
    )


def align_span(features: DataFrame, start_col: str = "answer_start", end_col: str = "answer_end",
               n_special: int = 3) -> DataFrame:
    """Character span -> token positions in the packed sequence.

    ``(0, 0)`` when there is no answer or the window's context does not hold the whole
    answer; otherwise the last token starting at or before the answer start and the
    first token ending at or after the answer end (offsets rise, so counting equals
    the reference's two scans).
    """
    w = F.col("_w")
    sc, ec = F.col(start_col), F.col(end_col)
    ctx_off = F.col("q_len") + F.lit(n_special - 1)
    inside = (
        sc.isNotNull() & ec.isNotNull() & (F.col("n_ctx") > 0)
        & (F.col("ctx_start") <= sc) & (F.col("ctx_end") >= ec)
    )
    if "_S" in features.columns:
        # bounds from the whole context, clipped to the window (same as the scans)
        a, b = F.col("ctx_first"), F.col("ctx_first") + F.col("n_ctx") - 1
        start_pos = ctx_off + F.least(F.col("_S"), b) - a
        end_pos = ctx_off + F.greatest(F.col("_E"), a) - a
    else:
        start_pos = ctx_off + F.size(F.filter(w, lambda t: t["start"] <= sc)) - 1
        end_pos = ctx_off + F.col("n_ctx") - F.size(F.filter(w, lambda t: t["end"] >= ec))
    return features.select(
        "*",
        F.when(inside, start_pos).otherwise(F.lit(0)).alias("start_position"),
        F.when(inside, end_pos).otherwise(F.lit(0)).alias("end_position"),
    )

