"""Nearest training text by shared idf weight (H2): an exact top-1 search over inverted indexes.

A text is the set of its lower-cased tokens; the score of a query and a training text is the sum of
the weights of the tokens that both have (idf in thousandths, a whole number, so sums and
ties are exact). Training texts are dealt into blocks; a task indexes one block and searches it for a
block of queries, so only the best of each (query, block) is shuffled, never a candidate pair.

Inside a block a query opens posting lists in falling order of weight and adds up scores. A text that
has none of the tokens so far can score at most the sum of the others: once that is below the
best score, and few texts can still win, no further list is opened (the frequent tokens at the end
mostly are not), and those few look their remaining tokens up.

Texts of equal token sets score alike, so each set is searched, and answered, once: copies cost one
aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.tokens import token_strings
from spanlake.session import cut_lineage

SCALE = 1000  # weights are in thousandths
#: Queries and training texts (different token sets) of a tile.
QUERY_BLOCK, TEXT_BLOCK = 512, 8_192
#: Texts whose remaining tokens are looked up one by one, in place of reading posting lists.
LOOKUPS = 64


def token_set(text: str | Column) -> Column:
    """Sorted distinct lower-cased tokens; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_sort(F.array_distinct(F.transform(token_strings(F.coalesce(c, F.lit(""))), F.lower)))


def _weights(sets: DataFrame) -> DataFrame:
    """``term, w``: idf over training texts, ``ln((N + 1) / (df + 1)) + 1``, in thousandths."""
    n = sets.agg(F.sum("n")).scalar()
    df = sets.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.round((F.log((n + 1) / (F.col("df") + 1)) + 1) * SCALE).cast("long").alias("w"))


def best_in_block(asked: list[tuple[list[str], list[int]]], texts: list[list[str]], opened: list[int] | None = None) -> list[tuple[int, int] | None]:
    """For each query (tokens and weights, heaviest first) the best (score, text) of ``texts`` (token lists), ties to
    the first; None where nothing is shared. ``opened`` collects the lengths of the posting lists read."""
    lists: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        for term in t:
            lists.setdefault(term, []).append(i)
    index = {term: np.array(at) for term, at in lists.items()}
    sets: dict[int, set[str]] = {}
    out: list[tuple[int, int] | None] = []
    for terms, weights in asked:
        have = [(index[t], t, w) for t, w in zip(terms, weights) if t in index]
        if not have:
            out.append(None)
            continue
        score, best = np.zeros(len(texts), np.int64), 0
        left = sum(h[2] for h in have)
        for k, (at, _, w) in enumerate(have):
            # an untouched text cannot win any more, and few of the others still can
            if left < best and np.count_nonzero(score + left >= best) <= LOOKUPS:
                break
            score[at] += w
            left -= w
            best = max(best, int(score[at].max()))
            if opened is not None:
                opened.append(len(at))
        else:
            k = len(have)
        live = np.flatnonzero(score + left >= best)
        for i in live if k < len(have) else ():
            terms_of = sets.setdefault(int(i), set(texts[i]))
            score[i] += sum(w for _, t, w in have[k:] if t in terms_of)
        win = int(live[score[live].argmax()])
        out.append((int(score[win]), win))
    return out


def _search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(left) and len(right):
        right = right.sort_values("d", kind="stable")  # ties go to the smallest key
        names = right["d"].tolist()
        found = best_in_block([([t["term"] for t in q], [t["w"] for t in q]) for q in left["weighted"]], [list(t) for t in right["terms"]])
        rows = [(q, f[0], names[f[1]]) for q, f in zip(left["q"], found) if f]
    return pd.DataFrame(rows, columns=["q", "score", "d"])


def nearest_text(queries: DataFrame, train: DataFrame, key: str = "pair_id", text: str = "Query", out: str = "Segment",
                 query_block: int = QUERY_BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """``key, match, score, <out>``: for every row of ``queries`` the row of ``train`` whose ``text`` shares the most
    weight with its own (ties: the smallest key), with that row's ``out``. Rows that share
    nothing with any training text have nulls; keys of ``train`` are unique."""
    # one row per different token set; ``d`` is the smallest key that has it
    sets = train.select(F.col(key).alias("k"), token_set(text).alias("terms")).where(F.size("terms") > 0)
    sets = cut_lineage(sets.groupBy("terms").agg(F.min("k").alias("d"), F.count(F.lit(1)).alias("n")), "text-sets")
    weights = _weights(sets)
    asked = cut_lineage(queries.select(F.col(key).alias("k"), token_set(text).alias("terms")), "asked")
    unique = asked.groupBy("terms").agg(F.min("k").alias("q"))
    # a query's tokens are bounded by its text
    known = unique.select("q", F.explode("terms").alias("t")).join(weights, F.col("t") == F.col("term")).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("down"), "term", "w"))).alias("weighted"))
    known = cut_lineage(known, "asked-weights")
    n = [df.count() for df in (known, sets)]
    across, down = (max(1, -(-m // size)) for m, size in zip(n, (query_block, text_block)))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = known.select(deal("q", across).alias("a"), each(down).alias("b"), "q", "weighted")
    right = sets.select(each(across).alias("a"), deal("d", down).alias("b"), "d", "terms")
    kind = f"q {known.schema['q'].dataType.simpleString()}, score long, d {sets.schema['d'].dataType.simpleString()}"
    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_search, kind)
    top = best.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("down"), "d")).alias("m"))
    answer = unique.join(top, "q").select(F.col("terms").alias("_terms"), F.col("m.d").alias("match"), (-F.col("m.down")).alias("score"))
    found = asked.join(answer, F.col("terms") == F.col("_terms"), "left").select(F.col("k").alias(key), "match", "score")
    return found.join(train.select(F.col(key).alias("_match"), out), F.col("match") == F.col("_match"), "left").drop("_match")
