"""Plan guards: the scale properties the design relies on stay in the physical plans."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from spanlake.plans.catalog import QUERIES
from spanlake.sources import views


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF_SMALL)) for name, fn in QUERIES.items()}


def test_containment_views_have_no_nested_loop(spark):
    """The plan of the view itself (queries may read it after a write), as a large table would run."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(views.qa_examples(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)


def test_scorer_runs_once(spark):
    p = _plan(QUERIES["pair_echo"](spark, SF_SMALL))
    assert len(re.findall(r"^\(\d+\) MapInPandas", p, re.M)) == 1, p[:3000]


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {n for n, p in plans.items() if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)}
    assert not bad


def _exchanges(plan: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan, re.M))


def test_tokenising_does_not_shuffle(plans):
    assert _exchanges(plans["tokenize_offsets"]) == 0, plans["tokenize_offsets"][:3000]


@pytest.mark.parametrize("name", ["sliding_windows", "align_span", "token_span_text"])
def test_windowing_adds_no_shuffle(spark, plans, name):
    assert _exchanges(plans[name]) == _exchanges(_plan(views.qa_examples(spark, SF_SMALL))), plans[name][:3000]


def test_best_span_has_one_aggregation_shuffle(plans):
    # one (partially pre-aggregated) shuffle by example id; no join of windows to contexts
    p = plans["best_span"]
    assert "partial_max" in p
    assert "SortMergeJoin" not in p


def test_logits_at_rest_join_without_exchange(spark):
    """Windows are cut before the plan starts; the only exchange left is the one by example id."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(QUERIES["span_from_logits"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert _exchanges(p) == 1 and "SortMergeJoin" in p and "text_to_tokens" not in p, p[:4000]
