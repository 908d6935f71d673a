"""Baseline: the value some rows earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import drop_incomplete
from ..plans.ordered import Panel, add_lags
from ..spec import ModelSpec
from .base import Fitted, Ranges, as_forecast
from .bounds import interval_of, residual_quantiles


def fit_lag(panel: Panel, ranges: Ranges, model: ModelSpec) -> Fitted:
    """Params: ``lag`` (1), ``interval`` (none): bounds from quantiles of the training residuals, of all series together.

    Training rows are scored too, since a lag has nothing to fit.
    """
    lag, level = int(model.params.get("lag", 1)), interval_of(model)
    name = f"target_lag_{lag}"
    lagged = panel.on(add_lags(panel, {name: (panel.spec.target, lag)}))

    def scored(kind: str) -> DataFrame:
        rows = drop_incomplete(ranges.rows(lagged, kind), [panel.spec.target, name])
        if level is None or kind == "train":
            return as_forecast(rows, panel, model, F.col(name))
        train = drop_incomplete(ranges.rows(lagged, "train"), [panel.spec.target, name])
        limits = residual_quantiles(train, F.col(panel.spec.target) - F.col(name), level)
        bounds = tuple(F.col(name) + F.get("_bounds", F.lit(side)) for side in (0, 1))
        return as_forecast(panel.attach_to(rows, limits, ()), panel, model, F.col(name), bounds)

    message = f"No training data available after applying lag {lag}"
    return Fitted(model, scored("predict"), train_scored=scored("train"), no_rows=message)
