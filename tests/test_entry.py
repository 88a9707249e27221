import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from spanlake.plans.catalog import QUERIES
from oracle_harness import compare, duck


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["id", "prediction_text", "em", "f1"]
    assert len(rows) == 3
    assert all(0.0 <= r.f1 <= 1.0 and r.em in (0.0, 1.0) for r in rows)


def test_every_core_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) == set(o) & set(QUERIES)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_parity_small(spark, name):
    con = duck(SF_SMALL)
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_match"], r
