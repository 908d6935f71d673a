"""Walk-forward validation against separate fits."""

from __future__ import annotations

from datetime import datetime

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.models.base import FixedRanges
from panelcast.models.ols import fit_ols
from panelcast.plans.ordered import Panel
from panelcast.spec import DateRange, ModelSpec, SeriesSpec
from panelcast.walk import Fold, folds, merged, validation, walk_linear

SPEC = SeriesSpec("ds", "y", ("key",))


@pytest.fixture(scope="module")
def panel(spark):
    df = spark.createDataFrame(data.panel_rows({"a": data.wave(500, 1, 300.0), None: data.wave(500, 2)}), data.SCHEMA)
    return Panel.of(df.persist(), SPEC)


@pytest.mark.parametrize(
    "params", [{"lags": [1, 7]}, {"lags": [1], "fit_scope": "series"}, {"lags": list(range(1, 16)), "fit_scope": "series"}, {"lags": [7], "target_mode": "residual"}]
)
@pytest.mark.parametrize("window", [None, 150])
def test_folds_equal_separate_fits(panel, params, window):
    model, steps = ModelSpec("m", "LINEAR_REGRESSION", "M", params), folds("2020-08-01", 3, 60, 40, window)
    got = walk_linear(panel, model, steps).withColumn("key", F.coalesce("key", F.lit("-"))).toPandas()
    for number, fold in enumerate(steps):
        train = DateRange(str(fold.start or datetime(1, 1, 1)), str(fold.cut.replace(microsecond=0) - (datetime(2020, 1, 2) - datetime(2020, 1, 1))))
        want = fit_ols(panel, FixedRanges([train], [DateRange(str(fold.cut), str(fold.end))]), model).forecast
        want = want.withColumn("key", F.coalesce("key", F.lit("-"))).toPandas().sort_values(["key", "ds"])
        part = got[got.range_id == number].sort_values(["key", "ds"])
        assert len(part) == len(want) == 80
        assert np.allclose(part.prediction, want.prediction, rtol=1e-7)


def test_merging_equals_all_rows_together():
    rng = np.random.default_rng(0)
    parts = [rng.normal(1e6, 1, (size, 3)) for size in (1, 7, 40)]

    def sums(x):
        c = x - x.mean(axis=0)
        return len(x), x.mean(axis=0), (c.T @ c)[np.triu_indices(3)]

    n, mean, products = (np.array(column) for column in zip(*map(sums, parts)))
    for a, b in zip(merged(n, mean, products), sums(np.concatenate(parts))):
        assert np.allclose(a, b, rtol=1e-9)


def test_folds_without_rows(panel):
    """A fold before the first row has no forecasts; the others are not disturbed."""
    steps = [Fold(None, datetime(2019, 1, 1), datetime(2019, 2, 1)), Fold(None, datetime(2021, 1, 1), datetime(2021, 1, 10))]
    got = walk_linear(panel, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1]}), steps).toPandas()
    assert set(got.range_id) == {1} and len(got) == 20


def test_other_models_are_fitted_per_fold(panel):
    models = [ModelSpec("l", "LAG", "Lag", {"lag": 7}), ModelSpec("o", "LINEAR_REGRESSION", "O", {"lags": [1]})]
    got = validation(panel, models, folds("2020-10-01", 2, 30), ("key",)).toPandas()
    assert len(got) == 8 and set(got.n) == {30} and got.rmse.notna().all()
    with pytest.raises(ValueError, match="Unknown"):
        validation(panel, [ModelSpec("x", "NBEATS", "X")], folds("2020-10-01", 2, 30))


def test_dates_rise():
    with pytest.raises(ValueError, match="rise"):
        Fold(None, datetime(2020, 1, 2), datetime(2020, 1, 1))
    with pytest.raises(ValueError, match="apart"):
        folds("2020-01-01", 0, 5)
