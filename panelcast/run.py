"""Fit and compare many models on one table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException, IllegalArgumentException, PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models.arima import fit_arima
from .models.base import Fitted, Ranges
from .models.decomp import fit_decomp
from .models.gbt import fit_gbt
from .models.lag import fit_lag
from .models.ols import fit_ols
from .operators.clean import clean_for_training
from .operators.evaluate import METRICS, leaderboard, metrics
from .operators.features import lag_columns
from .plans.lineage import cut
from .plans.ordered import Panel, add_lags
from .spec import FeatureConfig, ModelSpec, SeriesSpec, parse_lags
from .sources.files import forecast_table

# The model types.
TRAINERS = {
    "LAG": fit_lag,
    "LINEAR_REGRESSION": fit_ols,
    "XGBOOST": fit_gbt,
    "ARIMA": fit_arima,
    "PROPHET": fit_decomp,
}
#: What the data or the parameters of one model can cause. Anything else, such as a lost cluster, stops the run.
FAILURES = (ValueError, TypeError, ArithmeticError, AnalysisException, IllegalArgumentException)
TASK_FAILURES = ("ValueError", "ArithmeticError", "ZeroDivisionError", "OverflowError", "numpy.linalg.LinAlgError")
RESULT_SCHEMA = (
    "model_id string, model_name string, status string, message string, scope string, "
    "rmse double, mae double, mape double, r2 double, n long, seconds double, series_scored long, series_skipped long"
)


@dataclass(frozen=True)
class Run:
    """Results of all models: one row per model and scope, and the tables of each model that worked.

    ``series_scored`` counts the series with scored rows, ``series_skipped`` those that could not be fitted.
    """

    results: DataFrame
    spec: SeriesSpec
    forecasts: dict[str, DataFrame] = field(default_factory=dict)
    fitted: dict[str, Fitted] = field(default_factory=dict)

    def leaderboard(self) -> DataFrame:
        return leaderboard(self.results.filter(F.col("scope") == "predict"))

    def forecast(self) -> DataFrame:
        """All forecasts, long: one row per model, range, series and date."""
        if not self.forecasts:
            raise ValueError("No model has a forecast")
        return reduce(DataFrame.unionByName, self.forecasts.values())

    def by_series(self) -> DataFrame:
        """Metrics of the forecasts per model and series."""
        return metrics(self.forecast(), ("model_id", *self.spec.keys))

    def skipped(self) -> DataFrame:
        """Series that a model could not be fitted to, and why."""
        listed = [f.skipped.select(F.lit(i).alias("model_id"), *self.spec.keys, "reason") for i, f in self.fitted.items() if f.skipped is not None]
        if not listed:
            raise ValueError("No model is fitted series by series")
        return reduce(DataFrame.unionByName, listed)

    def forecast_table(self) -> DataFrame:
        models = [(model_id, self.fitted[model_id].model.name) for model_id in self.forecasts]
        return forecast_table(self.forecast(), models, self.spec.date, self.spec.keys)

    def importance(self) -> DataFrame:
        keyed = [f.importance for f in self.fitted.values() if f.importance is not None]
        if not keyed:
            raise ValueError("No model has importances")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)


def train_models(df: DataFrame, spec: SeriesSpec, models: list[ModelSpec], ranges: Ranges) -> Run:
    """Clean a raw table and run the models on it."""
    return run_models(Panel.of(clean_for_training(df, spec), spec), models, ranges)


def run_models(panel: Panel, models: list[ModelSpec], ranges: Ranges) -> Run:
    """Fit and score each model. One that fails is recorded with its message, without metrics; the others go on.

    The lags of all models are made in one ordering pass and kept while the models run. Each forecast is
    written once, so its metrics and every later use read the same rows.
    """
    lags = _all_lags(panel, models)
    shared = add_lags(panel, lags).persist()
    ready = replace(panel, df=shared, ready=frozenset(lags))
    rows, forecasts, fitted = [], {}, {}
    try:
        for model in models:
            began = time.monotonic()
            try:
                if model.type not in TRAINERS:
                    rows.append((model.id, model.name, "unsupported", f"Unknown model type {model.type}", None))
                    continue
                fit = TRAINERS[model.type](ready, ranges, model)
                scored = [("predict", cut(fit.forecast))]
                if fit.train_scored is not None:
                    scored.append(("train", fit.train_scored))
                measured = _measure(scored, panel.spec.keys)
                skipped = fit.skipped.count() if fit.skipped is not None else 0
                if fit.no_rows and measured["train"]["n"] == 0:
                    raise ValueError(fit.no_rows)
                seconds = time.monotonic() - began
                for scope, m in measured.items():
                    values = [m[name] for name in METRICS]
                    rows.append((model.id, model.name, "ok", None, scope, *values, m["n"], seconds, m["series"], skipped))
                forecasts[model.id], fitted[model.id] = scored[0][1], fit
            except (*FAILURES, PythonException) as error:  # one model's failure must not stop the others
                if not own_failure(error):
                    raise
                rows.append((model.id, model.name, "error", str(error), None))
    finally:
        shared.unpersist()
    padded = [(*row, *[None] * (13 - len(row))) for row in rows]
    results = panel.df.sparkSession.createDataFrame(padded, RESULT_SCHEMA)
    return Run(results, panel.spec, forecasts, fitted)


def own_failure(error: Exception) -> bool:
    """Whether data or parameters of a model caused an error, also where a task's Python code met it."""
    if not isinstance(error, PythonException):
        return isinstance(error, FAILURES)
    lines = [line for line in str(error).splitlines() if line.startswith(TASK_FAILURES)]
    return bool(lines)


def _measure(scored: list[tuple[str, DataFrame]], keys: tuple[str, ...]) -> dict:
    """Per scope the metrics, and how many series have a row."""
    tables = []
    for scope, df in scored:
        series = df.select(*keys).distinct() if keys else df.limit(1)
        count = series.agg(F.count(F.lit(1)).alias("series")).select(F.struct("series").alias("_s"))
        tables.append(metrics(df).select("*", count.scalar()["series"].alias("series"), F.lit(scope).alias("scope")))
    return {row["scope"]: row for row in reduce(DataFrame.unionByName, tables).collect()}


def _all_lags(panel: Panel, models: list[ModelSpec]) -> dict[str, tuple[str, int]]:
    """Lags wanted by any model whose parameters can be read; the others fail later, each on its own."""
    target, present = panel.spec.target, set(panel.df.columns)
    defaults = {"LINEAR_REGRESSION": [1, 7], "XGBOOST": [1, 7, 14, 30]}
    lags: dict[str, tuple[str, int]] = {}
    for model in models:
        p = model.params
        try:
            if model.type == "LAG":
                wanted = [int(p.get("lag", 1))]
            elif model.type == "PROPHET":
                wanted = parse_lags(p.get("lag_regressors", [1, 7])) if p.get("use_lag_regressors", True) else []
            elif model.type in defaults:
                config = FeatureConfig.from_params(p, defaults[model.type])
                lags |= lag_columns(config, target, present)
                wanted = [int(p.get("residual_lag", 1))] if p.get("target_mode") == "residual" else []
            else:
                wanted = []
            lags |= {f"target_lag_{k}": (target, k) for k in wanted if k >= 0}
        except (TypeError, ValueError):
            continue
    return lags
