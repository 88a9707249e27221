"""Hard negatives against brute force, and the bounds of the angular filter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, step=100, low=30, high=90):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, y) in enumerate(ok):
        if i % step:
            continue
        others = [(-dot(v, w), j, z) for m, (j, w, z) in enumerate(ok) if m != n and len(w) == len(v)]
        for down, j, _ in sorted(o for o in others if o[2] == y)[:5]:
            best = sorted((d, k) for d, k, z in others if z != y and low * -down <= 100 * -d <= high * -down)[:10]
            out += [(i, j, r + 1, k, -down, -d) for r, (d, k) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in data]
    got = queries.op13_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and want


@pytest.mark.parametrize("blocks", [(2048, 1024), (2, 19)])
def test_ties_copies_and_odd_rows(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(260)]
    rows += [(i, [0.5] * 6, 1 + (i % 4 == 0)) for i in range(400, 520)]  # a hot vector
    rows += [(100, [1.0] * 6, 0), (100, [1.0] * 6, 0), (0, [0.25] * 6, 2)]  # repeated ids and rows
    rows += [(600, None, 1), (601, [], 1), (700, [], 2), (602, [float("nan")] * 6, 1), (603, [float("inf")] * 6, 1), (604, [None] * 6, 1), (605, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(800, [0.0] * 6, 0), (900, [0.5, 0.5], 0), (901, [0.5, 0.4], 0), (902, [0.3, 0.3], 1), (903, [-0.5, -0.4], 1)]
    df = spark.createDataFrame(rows, VEC).withColumn("rank", F.lit(0)).withColumn("rid", F.lit("x"))
    got = hard_negatives.mine(df, anchor_block=blocks[0], row_block=blocks[1]).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_empty_and_no_negatives(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], VEC)
    assert hard_negatives.mine(df).count() == 0 and hard_negatives.mine(df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    a = [3.0e4, 1.0, 2.0**20], [2.0**20, 0.5, 3.0e4], [1.0e6, 0.25, 7.0e5]
    rows = [(0, a[0], 0), (1, a[1], 0), (2, a[2], 1), (3, [2.0e4, 0.0, 1.0e5], 1), (4, [8.0e5, 0.0, 1.0e4], 1)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VEC)).collect()) == brute(rows)
    big = np.array([[2.0**40, 3.0], [2.0**30, -5.0]])
    assert hard_negatives.scores(big, big).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**60 + 25]]
    assert hard_negatives.mine(spark.createDataFrame([(0, [3.0e38], 0), (1, [3.0e38], 0), (2, [2.0e38], 1)], VEC)).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 12))
    a = np.floor(256 * (centre[rng.integers(0, 4, 50)] + 0.1 * rng.normal(size=(50, 12))))
    b = np.floor(256 * np.concatenate([centre[rng.integers(0, 4, 300)] + 0.1 * rng.normal(size=(300, 12)), a[:10], -a[:10], np.zeros((1, 12))]))
    low, high = hard_negatives.score_bounds(*hard_negatives.stored(a), *hard_negatives.stored(b))
    true = hard_negatives.scores(a, b)
    assert (low <= true).all() and (true <= high).all()
    for dim in (1, 2, 3):
        x, y = rng.integers(-300, 300, (40, dim)).astype(float), rng.integers(-300, 300, (40, dim)).astype(float)
        low, high = hard_negatives.score_bounds(*hard_negatives.stored(x), *hard_negatives.stored(y))
        assert (low <= x @ y.T).all() and (x @ y.T <= high).all()


def test_window_ends():
    for p in range(-50, 400):
        lo, hi = hard_negatives.window(p)
        assert [s for s in range(-400, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(lo, hi + 1))
