"""Windows over shared contexts: the rows of the direct path, each different context tokenised once."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from spanlake.operators import contexts, windows
from spanlake.plans.catalog import QUERIES
from spanlake.sources import views

EX = "id string, question string, context string, answer_start int, answer_end int"
COLS = ["id", "window_no", "q_len", "ctx_first", "n_ctx", "seq_len", "ctx_index_first", "ctx_index_last", "ctx_start", "ctx_end", "ctx_text",
        "too_long", "tokens", "seq_ids", "offsets", "start_position", "end_position"]


def both(ex, **how):
    direct = windows.align_span(windows.window_features(ex, keep=["answer_start", "answer_end"], answer_cols=("answer_start", "answer_end"), **how))
    keyed = ex.withColumn("ctx_key", contexts.context_key())
    shared = windows.align_span(contexts.shared_window_features(keyed, contexts.distinct_contexts(ex), keep=["answer_start", "answer_end"], **how))
    rows = lambda df: sorted(map(str, df.select(*COLS).collect()))
    return rows(direct), rows(shared)


def test_same_rows_as_the_direct_path(spark):
    long = " ".join(f"w{i}," for i in range(200))
    rows = [("a", "who is it?", long, 10, 30), ("b", "who", long, 700, 720), ("c", "who is it?", long, None, None), ("d", None, long, 0, 3),
            ("e", "what", None, None, None), ("f", "what", "", None, None), ("g", "q " * 60, long, 5, 9), ("h", "who is it?", "é́ 漢字, \U0001f600!", 0, 2),
            ("a", "who is it?", long, 10, 30)]
    direct, shared = both(spark.createDataFrame(rows, EX), max_length=48, stride=8)
    assert direct == shared and len(direct) > 40


def test_same_rows_on_the_driver_tables(spark):
    direct, shared = both(views.asked_documents(spark, SF_SMALL).where("doc_id % 5 = 0"), max_length=256, stride=64)
    assert direct == shared


def test_copies_are_one_context_and_one_tokenisation(spark):
    ex = views.asked_documents(spark, SF_SMALL)
    n_docs = ex.select("doc_id").distinct().count()
    assert contexts.distinct_contexts(ex).count() == ex.select("context").distinct().count() < n_docs
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES["shared_contexts"](spark, SF_SMALL).explain("formatted")
    # a plan for the contexts and one for the questions, the latter once in each branch that reads them
    cut = re.findall(r"^\(\d+\) ArrowEvalPython.*?Arguments: \[text_to_tokens\(([^)]*)\)", buf.getvalue(), re.M | re.S)
    assert sum(c.startswith("context") for c in cut) == 1, cut


def test_questions_of_unknown_contexts_give_no_row(spark):
    q = spark.createDataFrame([("a", "who", "one text"), ("b", "who", "two")], "id string, question string, context string").withColumn("ctx_key", contexts.context_key())
    known = contexts.distinct_contexts(q.where("id = 'a'"))
    assert [r.id for r in contexts.shared_window_features(q, known).collect()] == ["a"]
    none = contexts.distinct_contexts(q.limit(0))
    assert none.count() == 0 and contexts.shared_window_features(q, none).count() == 0
