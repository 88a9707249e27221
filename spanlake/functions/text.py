"""String functions on Columns: strip, slices, normalisation and tokenisers.

All patterns are Java regular expressions that RE2 (DuckDB) reads the same way, so the
SQL oracle can use them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
# Characters Python's str.isspace() accepts (what str.strip()/str.split() remove).
WS_CLASS = (
    r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Word characters of the native tokenizer: letters, marks, digits, underscore.
WORD_CLASS = r"\p{L}\p{M}\p{N}_"
# A token is a run of word characters or one other non-space character.
TOKEN_PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{WS_CLASS}]"
# Leading whitespace run (group 1) and the token after it (group 2).
GAP_TOKEN_PATTERN = rf"([{WS_CLASS}]*)({TOKEN_PATTERN})"
# SQuAD answer normalisation: ASCII punctuation (Python string.punctuation) and articles.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
# ROUGE tokenisation: lower case, anything but [a-z0-9] is a separator.
ROUGE_SPLIT = r"[^a-z0-9]+"
# SacreBLEU 13a: entity replacements (in this order) and the four regex rules.
TOK13A_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOK13A_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)
# -------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_text(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def ws_split(col) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty tokens."""
    # bind the stripped text once (one-element transform) instead of stripping twice
    return F.get(
        F.transform(
            F.array(strip_text(col)),
            lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(
                F.split(s, rf"[{WS_CLASS}]+", -1)
            ),
        ),
        0,
    )


def span_text(context, start, end) -> Column:
    """``context[start:end]`` with 0-based code-point offsets."""
    s, e = _c(start), _c(end)
    return F.when(s.isNull() | e.isNull(), F.lit(None)).otherwise(
        F.substring(_c(context), s + 1, F.greatest(e - s, F.lit(0)))
    )


def squad_normalize(col) -> Column:
    """SQuAD answer normalisation (G0): lower, drop ASCII punctuation, drop articles,
    collapse whitespace."""
    lowered = F.lower(_c(col))
    no_punct = F.translate(lowered, ASCII_PUNCTUATION, "")
    arts = "|".join(ARTICLES)
    no_art = F.regexp_replace(no_punct, rf"(?<![\p{{L}}\p{{N}}_])({arts})(?![\p{{L}}\p{{N}}_])", " ")
    return F.array_join(ws_split(no_art), " ")


def squad_tokens(col) -> Column:
    """Tokens of the normalised answer (``normalize(s).split()``)."""
    return ws_split(squad_normalize(col))


def tokens_13a(col) -> Column:
    """SacreBLEU 13a tokens, case kept."""
    s = F.regexp_replace(_c(col), "<skipped>", "")
    s = F.regexp_replace(s, "-\n", "")
    s = F.regexp_replace(s, "\n", " ")
    for ent, rep in TOK13A_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(rep))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in TOK13A_RULES:
        s = F.regexp_replace(s, pat, rep)
    return ws_split(s)


def rouge_tokens(col) -> Column:
    """ROUGE tokens: lower case, split on anything but [a-z0-9]."""
    return ws_split(F.regexp_replace(F.lower(_c(col)), ROUGE_SPLIT, " "))


def ngrams(tokens, n: int) -> Column:
    """All contiguous n-grams of a token array (joined by U+001F); empty when there are
    fewer than n tokens."""
    t = _c(tokens)
    if n == 1:
        return t
    count = F.size(t) - (n - 1)
    return F.when(count <= 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(t, i, n), "\u001f"))
    )
