"""Best candidates by bounds against every pair listed, on logits full of ties and gaps."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

import pyref
from spanlake.functions import arrow_helpers as A
from spanlake.operators import decode


def _random_window(rng, width, ties):
    value = (lambda: float(rng.randint(-2, 3))) if ties else (lambda: rng.uniform(-5, 5))
    offsets = [None if rng.random() < 0.25 else (i, i + 1) for i in range(width)]
    return [value() for _ in range(width)], [value() for _ in range(width)], offsets


@pytest.mark.parametrize("n_best,most", [(1, 1), (5, 4), (20, 100), (7, 2)])
@pytest.mark.parametrize("ties", [True, False])
def test_equals_the_listed_pairs(n_best, most, ties):
    rng = random.Random(n_best)
    context = "".join(chr(97 + i % 26) for i in range(200))
    rows = [_random_window(rng, rng.randint(0, 60), ties) for _ in range(300)]
    arr = lambda k, kind: pa.array([r[k] for r in rows], pa.list_(kind))
    chars = lambda j: pa.array([[None if o is None else o[j] for o in r[2]] for r in rows], pa.list_(pa.int32()))
    width = max(len(r[0]) for r in rows)
    logits = [np.nan_to_num(A._matrix(arr(k, pa.float32()), width, np.nan, np.float32), nan=-np.inf) for k in (0, 1)]
    score, si, ei, first, last = A.span_search(*logits, A._matrix(chars(0), width, -1, np.int64), A._matrix(chars(1), width, -1, np.int64), n_best, most)
    for i, r in enumerate(rows):
        got = context[first[i] : last[i]] if si[i] >= 0 else ""
        assert got == pyref.best_span_loop([r], n_best, most, context), r


def test_top_is_a_reversed_stable_sort():
    rng = np.random.default_rng(0)
    for width in (0, 1, 5, 40):
        m = rng.integers(0, 4, (50, width)).astype(np.float32)
        for n in (1, 3, 50):
            at, value = A._top(m, n)
            want = np.argsort(m, axis=1, kind="stable")[:, ::-1][:, :n]
            assert (at == want).all() and (value == np.take_along_axis(m, want, axis=1)).all()


SCHEMA = "id string, window_no int, ctx_text string, ctx_start int, offsets array<struct<start:int,end:int>>, start_logits array<float>, end_logits array<float>"


def test_odd_logits_do_not_crash(spark):
    off, nan, inf = [None, (3, 4), (4, 6)], math.nan, math.inf
    rows = [("ok", 0, "abc", 3, off, [9.0, 1.0, 2.0], [9.0, 1.0, 2.0]), ("nan", 0, "abc", 3, off, [nan, nan, 1.0], [0.0, 0.0, nan]),
            ("inf", 0, "abc", 3, off, [0.0, inf, 1.0], [0.0, 2.0, 1.0]), ("short", 0, "abc", 3, off, [1.0], [1.0]), ("null", 0, "abc", 3, off, [None, 1.0, None], [None, None, 2.0]),
            ("none", 0, "abc", 3, off, None, None), ("empty", 0, "", None, [], [], []), ("long", 0, "abc", 3, off, [0.0, 1.0, 1.0, 50.0], [0.0, 1.0, 1.0, 50.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.prediction_text for r in decode.best_span(df.select("id"), df, 3, 5).collect()}
    assert got == {"ok": "bc", "nan": "", "inf": "a", "short": "", "null": "abc", "none": "", "empty": "", "long": "bc"}


def test_windows_are_searched_in_bounded_pieces():
    rng = random.Random(3)
    rows = [_random_window(rng, rng.randint(0, 9), True) for _ in range(2 * A.SEARCH_ROWS + 7)]
    logits = [pa.array([r[k] for r in rows], pa.list_(pa.float32())) for k in (0, 1)]
    chars = [pa.array([[None if o is None else o[j] for o in r[2]] for r in rows], pa.list_(pa.int32())) for j in (0, 1)]
    context = "".join(chr(97 + i) for i in range(20))
    got = list(A.best_candidates(3, 4).func(iter([(*logits, *chars)])))
    assert [len(p) for p in got] == [A.SEARCH_ROWS, A.SEARCH_ROWS, 7]
    for r, b in zip(rows, (x for p in got for x in p.to_pylist())):
        assert ("" if b is None else context[b["start_char"] : b["end_char"]]) == pyref.best_span_loop([r], 3, 4, context), r
