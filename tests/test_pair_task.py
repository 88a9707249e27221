"""The pair task: the registered query scores the whole validation split, the operator's default is
the strict sample of 1,000 pairs."""

import inspect
import math

import pytest

from conftest import SF_SMALL
from oracle_harness import duck
from spanlake.operators import dedup
from spanlake.plans import pairs as pair_plan
from spanlake.plans.catalog import QUERIES
from spanlake.plans.sql_oracle import ORACLE
from spanlake.sources import views


def test_registered_query_scores_the_whole_validation_split(spark):
    n = dedup.drop_all_duplicates(views.pairs(spark, SF_SMALL).select("Query", "Segment")).count()
    got = {r.pair_id: r for r in QUERIES["pair_end_to_end"](spark, SF_SMALL).collect()}
    assert len(got) == math.ceil(n * 0.1) > 3
    rows = list(duck(SF_SMALL).execute(ORACLE["pair_end_to_end"]).df().itertuples())
    assert len(rows) == len(got)
    for r in rows:
        s = got[r.pair_id]
        assert s.prediction_text == r.prediction_text and s.em == r.em
        assert abs(s.f1 - r.f1) < 1e-4 and abs(s.bleu - r.bleu) < 1e-4


def _pairs(spark, n):
    return spark.range(n).selectExpr("concat('p', id) AS pair_id", "concat('how ', id) AS Query", "concat('so ', id) AS Segment")


def test_default_is_a_strict_sample_of_1000(spark):
    assert inspect.signature(pair_plan.run_pair_task).parameters["k_val"].default == 1000
    assert pair_plan.run_pair_task(_pairs(spark, 10_100)).count() == 1000
    with pytest.raises(IndexError):
        pair_plan.run_pair_task(_pairs(spark, 9_990))


def test_none_keeps_every_validation_pair(spark):
    assert pair_plan.run_pair_task(_pairs(spark, 10_100), k_val=None).count() == 1010
