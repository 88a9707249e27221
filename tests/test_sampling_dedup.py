import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlake.operators import dedup, sampling


def _ids(spark, n, parts):
    return spark.range(n).withColumnRenamed("id", "k").repartition(parts)


def _py_order(n, seed):
    return sorted(range(n), key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("parts", [1, 16])
def test_shuffle_rank_is_exact_and_partition_invariant(spark, parts):
    n = 500
    got = sampling.shuffle(_ids(spark, n, parts), "k", seed=42).select("k", "rank").collect()
    ranks = {r.k: r.rank for r in got}
    want = {k: i + 1 for i, k in enumerate(_py_order(n, 42))}
    assert ranks == want


def test_digits_do_not_change_ranks(spark):
    df = _ids(spark, 300, 4)
    a = {r.k: r.rank for r in sampling.shuffle(df, "k", 7, digits=1).collect()}
    b = {r.k: r.rank for r in sampling.shuffle(df, "k", 7, digits=4).collect()}
    assert a == b


def test_sample_exact_and_strict(spark):
    df = _ids(spark, 50, 3)
    s = sampling.sample_exact(df, "k", 10, seed=1).collect()
    assert sorted(r.k for r in s) == sorted(_py_order(50, 1)[:10])
    assert sampling.sample_exact(df, "k", 80, seed=1, strict=False).count() == 50
    with pytest.raises(IndexError):
        sampling.sample_exact(df, "k", 80, seed=1, strict=True)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 30, 233])
def test_split_sizes(spark, n):
    out = sampling.train_val_split(_ids(spark, n, 5), "k", 0.10, seed=3).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in out}
    assert sizes.get("val", 0) == sampling.n_val_rows(n, 0.10)
    assert sizes.get("val", 0) + sizes.get("train", 0) == n


def test_drop_all_duplicates_matches_pandas(spark):
    rows = [("a", "x", 1), ("a", "x", 2), ("b", None, 3), ("b", None, 4), ("c", None, 5),
            ("a", "y", 6), (None, None, 7), ("d", "x", 8), ("d", "x", 9), ("d", "x", 10)]
    df = spark.createDataFrame(rows, "q string, s string, i int")
    key = lambda t: tuple((v is None, str(v)) for v in t)
    got = sorted((tuple(r) for r in dedup.drop_all_duplicates(df, ["q", "s"]).collect()), key=key)
    pdf = pd.DataFrame(rows, columns=["q", "s", "i"])
    want = sorted(
        (tuple(None if pd.isna(v) else v for v in r)
         for r in pdf[~pdf.duplicated(subset=["q", "s"], keep=False)].itertuples(index=False)),
        key=key,
    )
    assert got == want
    whole = dedup.drop_all_duplicates(df.select("q", "s")).count()
    assert whole == len(pdf[["q", "s"]].drop_duplicates(keep=False))


def test_sample_is_the_head_of_the_shuffle(spark):
    df = _ids(spark, 200, 6)
    for k in (0, 1, 37, 200):
        some = sorted(tuple(r) for r in sampling.sample_exact(df, "k", k, seed=9, digits=1).select("k", "rank").collect())
        assert some == sorted(tuple(r) for r in sampling.shuffle(df, "k", 9).where(f"rank <= {k}").select("k", "rank").collect())
    assert sampling.sample_exact(df, "k", 300, strict=False).count() == 200
    with pytest.raises(ValueError):
        sampling.shuffle(df, "k", digits=9)


def test_repeated_keys_are_deterministic(spark):
    rows = [(k % 5, f"v{k}") for k in range(60)]  # each key 12 times, values differ
    a = spark.createDataFrame(rows, "k long, v string").repartition(1)
    b = spark.createDataFrame(list(reversed(rows)), "k long, v string").repartition(7)
    ra = sorted(tuple(r) for r in sampling.shuffle(a, "k", 3).collect())
    rb = sorted(tuple(r) for r in sampling.shuffle(b, "k", 3).collect())
    assert ra == rb
    sa = sorted(tuple(r) for r in sampling.sample_exact(a, "k", 17, 3).collect())
    sb = sorted(tuple(r) for r in sampling.sample_exact(b, "k", 17, 3).collect())
    assert sa == sb
