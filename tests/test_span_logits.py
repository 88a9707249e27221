"""Decoding from a table of model output: every window has logits over its whole sequence, and
windows and examples without any are no candidates."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle_harness import compare
from spanlake.operators import windows
from spanlake.plans import span as span_plan
from spanlake.plans.catalog import QUERIES
from spanlake.plans.sql_oracle import ORACLE
from spanlake.sources import views


def test_every_window_has_logits_for_its_whole_sequence(spark):
    ids = views.table(spark, SF_SMALL, "embeddings").selectExpr("vec_id AS id")
    docs = views.doc_examples(spark, SF_SMALL).join(ids, "id", "left_semi")
    want = {(r.id, r.window_no): r.seq_len for r in
            windows.window_features(docs, 512, 128, question_col=None).select("id", "window_no", "seq_len").collect()}
    got = {(r.id, r.window_no): (len(r.start_logits), len(r.end_logits)) for r in views.logits_table(spark, SF_SMALL).collect()}
    assert got == {k: (n, n) for k, n in want.items()}
    assert max(want.values()) > 64


def test_logits_repeat_the_vector(spark):
    f = spark.createDataFrame([("a", 1, [1.0, 2.0, 3.0])], "id string, window_no int, _e array<float>")
    r = views.embedding_logits(f.selectExpr("*", "7 AS n"), F.col("n")).first()
    assert list(r.start_logits) == [2, 3, 1, 2, 3, 1, 2] and list(r.end_logits) == [1, 3, 2, 1, 3, 2, 1]


def test_windows_without_logits_are_no_candidates(spark):
    words = [f"w{i}" for i in range(40)]
    ex = spark.createDataFrame([(i, " ".join(words)) for i in ("late", "none", "some")], "id string, context string")
    f = windows.window_features(ex, 16, 4, question_col=None).select("id", "window_no", "seq_len").collect()
    last = max(r.window_no for r in f)
    assert last >= 3
    # the best span of a window stands at position 5, and later windows score higher
    peak = lambda r: [float(r.window_no + 1) if i == 5 else 0.0 for i in range(r.seq_len)]
    rows = [(r.id, r.window_no, peak(r), peak(r)) for r in f if r.id == "late" or (r.id == "some" and r.window_no == 1)]
    logits = spark.createDataFrame(rows, "id string, window_no int, start_logits array<float>, end_logits array<float>")
    got = {r.id: r.prediction_text for r in span_plan.decode_with_logits(ex, logits, 16, 4, 5, 10).collect()}
    assert got == {"late": words[last * 9 + 3], "some": words[9 + 3], "none": ""}


def test_query_equals_the_twin_over_all_windows(spark):
    r = compare(spark, "span_from_logits", QUERIES["span_from_logits"], ORACLE["span_from_logits"], SF_SMALL)
    assert r["cols_match"] and r["spark_rows"] == r["duck_rows"] and r["values_match"], r
