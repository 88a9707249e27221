"""Same results on 1 and 16 input partitions."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from spanlake.operators import decode, encode, sampling, windows
from spanlake.sources import views


def _docs(spark, parts):
    return (
        spark.read.parquet(f"{SF_MID}/documents.parquet")
        .select(F.col("doc_id").alias("id"), F.col("text").alias("context"))
        .repartition(parts)
    )


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("_e")
    )
    for parts in (1, 16):
        docs = _docs(spark, parts)
        feats = windows.window_features(docs.join(emb, "id"), 64, 16, question_col=None, keep=["_e"])
        best = decode.best_span(docs, views.embedding_logits(feats), 5, 10)
        vocab = encode.build_vocab(docs, ["context"])
        split = sampling.train_val_split(docs.select("id"), "id", 0.1, seed=5)
        out[parts] = (
            sorted(tuple(r) for r in best.select("id", "prediction_text").collect()),
            sorted(tuple(r) for r in vocab.collect()),
            sorted(tuple(r) for r in split.select("id", "split", "rank").collect()),
        )
    return out


def test_best_span_invariant(results):
    assert results[1][0] == results[16][0]


def test_vocab_invariant(results):
    assert results[1][1] == results[16][1]


def test_split_invariant(results):
    assert results[1][2] == results[16][2]
