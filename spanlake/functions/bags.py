"""Multiset ("bag of tokens") arithmetic inside a row, without exploding.

Exact match, token F1, BLEU clipped counts and ROUGE-N hits are all the size of a
multiset intersection. It is computed in O(n log n) per row: sort, count runs, merge
the two run lists by one more sort. No shuffle, no Python.

Spark does not share common subexpressions inside lambdas, so every intermediate
array is bound once with :func:`let` before a lambda reads it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element ``transform``)."""
    return F.get(F.transform(F.array(_c(value)), body), 0)


def _empty_runs() -> Column:
    return F.filter(
        F.array(F.struct(F.lit("").alias("v"), F.lit(0).alias("c"))), lambda x: F.lit(False)
    )


def counted(arr) -> Column:
    """Distinct values with their multiplicity, ``array<struct<v, c:int>>`` sorted by v."""

    def runs(s):
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.when(i == 1, F.lit(True)).otherwise(
                F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))
            ),
        )
        return let(
            starts,
            lambda st: F.zip_with(
                st,
                F.concat(F.slice(st, 2, F.greatest(F.size(st), F.lit(1))), F.array(n + 1)),
                lambda a, b: F.struct(F.element_at(s, a).alias("v"), (b - a).alias("c")),
            ),
        )

    return let(
        F.array_sort(_c(arr)),
        lambda s: F.when(F.size(s) <= 0, _empty_runs()).otherwise(runs(s)),
    )


def max_union(run_lists) -> Column:
    """Per value, the largest multiplicity over several run lists (``Counter |``)."""

    def keep(allr):
        return F.filter(
            allr,
            lambda x, i: F.when(i == 0, F.lit(True)).otherwise(
                F.element_at(allr, F.greatest(i, F.lit(1)))["v"] != x["v"]
            ),
        )

    return let(
        F.array_sort(
            F.transform(
                F.flatten(_c(run_lists)),
                lambda x: F.struct(x["v"].alias("v"), (-x["c"]).alias("nc")),
            )
        ),
        lambda allr: F.transform(
            keep(allr), lambda x: F.struct(x["v"].alias("v"), (-x["nc"]).alias("c"))
        ),
    )


def runs_overlap(runs_a, runs_b) -> Column:
    """Sum over values of min(count in a, count in b), both given as run lists."""
    tagged = F.array_sort(
        F.concat(
            F.transform(_c(runs_a), lambda x: F.struct(x["v"].alias("v"), F.lit(0).alias("side"), x["c"].alias("c"))),
            F.transform(_c(runs_b), lambda x: F.struct(x["v"].alias("v"), F.lit(1).alias("side"), x["c"].alias("c"))),
        )
    )

    def total(t):
        m = F.size(t)
        return F.when(m < 2, F.lit(0)).otherwise(
            F.aggregate(
                F.sequence(F.lit(2), F.greatest(m, F.lit(2))),
                F.lit(0),
                lambda acc, i: acc
                + F.when(
                    F.element_at(t, i - 1)["v"] == F.element_at(t, i)["v"],
                    F.least(F.element_at(t, i - 1)["c"], F.element_at(t, i)["c"]),
                ).otherwise(F.lit(0)),
            )
        )

    return let(tagged, total)


def bag_overlap(a, b) -> Column:
    """Size of the multiset intersection of two string arrays."""
    return runs_overlap(counted(a), counted(b))

