"""Array functions on Columns: padding, masking, slicing, arg-sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pad_array(arr, n, pad) -> Column:
    """Right-pad ``arr`` with ``pad`` up to length ``n`` (never truncates)."""
    a = _c(arr)
    missing = F.greatest(_lit(n) - F.size(a), F.lit(0))
    return F.concat(a, F.array_repeat(_lit(pad), missing))


def truncate_array(arr, n) -> Column:
    """First ``n`` elements of ``arr``."""
    return F.slice(_c(arr), 1, _lit(n))


def mask_offsets(tokens, seg_field: str = "seg", context_seg: int = 1) -> Column:
    """Offsets of context tokens, NULL for question/special/padding positions."""
    return F.transform(
        _c(tokens),
        lambda t: F.when(
            t[seg_field] == context_seg, F.struct(t["start"].alias("start"), t["end"].alias("end"))
        ),
    )


def token_span(tokens, start, end, sep: str = " ") -> Column:
    """``sep.join(tokens[start:end+1])`` with 0-based inclusive token indices."""
    s, e = _c(start), _c(end)
    return F.array_join(F.slice(_c(tokens), s + 1, F.greatest(e - s + 1, F.lit(0))), sep)


def skip_specials(tokens, specials) -> Column:
    """Drop special tokens."""
    sp = F.array(*[F.lit(x) for x in specials]) if not isinstance(specials, Column) else specials
    return F.filter(_c(tokens), lambda t: ~F.array_contains(sp, t))


def top_n_indices(values, n: int) -> Column:
    """0-based indices of the ``n`` largest values, largest first; among equal values
    the higher index comes first (reverse of a stable ascending arg-sort) (F5)."""
    pairs = F.transform(_c(values), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, n), lambda z: z["i"])


def explode_rows(arr, name: str) -> tuple[Column, Column]:
    """``(generator, keep_condition)`` for one row per array element.

    A plain ``explode`` makes the optimizer add a ``size(arr) > 0`` filter below it,
    which evaluates an expensive array expression (a tokeniser) twice. The outer
    generator has no such filter; the NULL row it emits for an empty array is dropped
    by ``keep_condition`` afterwards. Elements themselves must not be NULL.
    """
    return F.explode_outer(_c(arr)).alias(name), F.col(name).isNotNull()


def posexplode_rows(arr, pos: str, name: str) -> tuple[Column, Column]:
    """Positional variant of :func:`explode_rows` (elements may be NULL)."""
    return F.posexplode_outer(_c(arr)).alias(pos, name), F.col(pos).isNotNull()
