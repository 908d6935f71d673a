"""Every query against its SQL on the smallest tables, in a session zone with daylight saving."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entries
import catalog

WITHOUT_SQL = {
    "arima_model", "attribution_rows", "decomp_importance", "decomp_model", "gbt_importance", "gbt_model",
}


@pytest.fixture(scope="module")
def tables(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_equals_sql(spark, sf, tables, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = tables.execute(catalog.oracles()[name]).fetchdf()
    assert len(want) > 0
    assert oracle.difference(got, want) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs_without_sql(spark, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    assert len(got) > 0
    numbers = got.select_dtypes("number")
    assert numbers.notna().all().all()


def test_every_other_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracles()) == WITHOUT_SQL


def test_entry(spark):
    rows = entries.entry(spark).toPandas()
    assert len(rows) > 0 and {"rmse", "mae", "mape", "r2"} <= set(rows.columns)
