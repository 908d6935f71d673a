"""Linear regression on configured features, one fit for all series or one per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import drop_incomplete, scaling, standardise, training_features
from ..plans.gram import BUILT_IN_COLUMNS, dot, moments, solve, solve_scaled
from ..plans.ordered import Panel
from ..spec import FeatureConfig, ModelSpec
from .base import Fitted, Ranges, as_forecast, fitted, importance_rows, kept, unfitted
from .bounds import around, interval_of, regression_deviation, spread


def fit_ols(panel: Panel, ranges: Ranges, model: ModelSpec) -> Fitted:
    """Params: ``feature_config`` or ``lags`` ([1, 7]), ``target_mode`` (raw or residual), ``residual_lag``
    (1), ``standardize`` (False), ``fit_scope`` (pooled or series), ``interval`` (none): bounds from the variances of noise
    and coefficients.

    Importance is the absolute coefficient, of standardised features if they are standardised.
    """
    params = model.params
    config, level = FeatureConfig.from_params(params, [1, 7]), interval_of(model)
    mode, residual_lag = params.get("target_mode", "raw"), int(params.get("residual_lag", 1))
    standardized = bool(params.get("standardize", False))
    keys = fit_keys(panel, params)
    features, target = training_features(panel, config, mode, residual_lag)
    names = features.names
    train = drop_incomplete(ranges.rows(features.panel, "train"), [*names, target])

    # A wide set of features is brought to one scale before its products are summed; unless standardised features
    # are asked for, the products are then brought back, so that the fit does not depend on the width.
    scaled = standardized or len(names) + 1 > BUILT_IN_COLUMNS
    message = "Not enough data after creating features"
    plain = solve("n", "mean", "products", F.lit(True))
    if scaled:
        with kept(train.select(*keys, *[F.col(f"`{name}`") for name in names], F.col(f"`{target}`"))) as rows:
            constants = fitted(scaling(rows, names, keys).filter(F.col(f"`_std_{names[0]}`").isNotNull()), message)
            sums = moments(standardise(panel, rows, constants, names, keys), keys, [*names, target])
            sums = panel.attach_to(sums, constants, keys)
            scales = F.array(*[F.col(f"`_std_{name}`") for name in names], F.lit(1.0))
            centres = F.array(*[F.col(f"`_mean_{name}`") for name in names], F.lit(0.0))
            sums = _with_spread(sums, scales, centres, level)
            if standardized:
                solved = unscaled(solved_from(sums, plain), names)
            else:
                solved = solved_from(sums, solve_scaled("n", "mean", "products", scales, centres))
            solved = fitted(solved.drop(*[c for c in solved.columns if c.startswith(("_mean_", "_std_"))]), message)
    else:
        ones, zeros = (F.array_repeat(F.lit(value), len(names) + 1) for value in (1.0, 0.0))
        sums = _with_spread(moments(train, keys, [*names, target]), ones, zeros, level)
        solved = fitted(solved_from(sums, plain), message)

    predict = drop_incomplete(ranges.rows(features.panel, "predict"), names)
    wanted = ["coef", "intercept"] + ["_spread"] * (level is not None)
    scored = panel.attach_to(predict, solved.select(*keys, *wanted), keys).filter(F.col("coef").isNotNull())
    prediction = linear_score(names)
    if mode == "residual":
        prediction = prediction + F.col(f"target_lag_{residual_lag}")
    sizes = solved.withColumn("_size", F.transform("scaled_coef" if standardized else "coef", F.abs))
    return Fitted(
        model,
        as_forecast(scored, panel, model, prediction, around(prediction, regression_deviation(names, "_spread"), level)),
        importance=importance_rows(sizes, keys, model, names, "_size"),
        skipped=unfitted(panel.df.select(*keys).distinct(), solved, keys, message) if keys else None,
    )


def _with_spread(sums: DataFrame, scales: Column, centres: Column, level: float | None) -> DataFrame:
    """Add what the forecast's variance is made of, where an interval is asked for."""
    if level is None:
        return sums
    return sums.filter(F.col("n") > 0).withColumn("_spread", spread("n", "mean", "products", scales, centres))


def solved_from(sums: DataFrame, fit: Column) -> DataFrame:
    """``coef`` in feature order and ``intercept`` by ``fit``, in place of the sums of fits that have rows."""
    solved = sums.filter(F.col("n") > 0).withColumn("_fit", fit)
    return solved.select(*[F.col(f"`{c}`") for c in sums.columns if c not in ("mean", "products")], "_fit.coef", "_fit.intercept")


def unscaled(solved: DataFrame, names: list[str]) -> DataFrame:
    """Coefficients for features as they are, from those for standardised ones (kept as ``scaled_coef``)."""
    coef = F.array(*[F.col("coef")[i] / F.col(f"`_std_{name}`") for i, name in enumerate(names)])
    means = F.array(*[F.col(f"`_mean_{name}`") for name in names])
    kept = [c for c in solved.columns if not c.startswith(("_mean_", "_std_"))]
    out = solved.withColumns({"scaled_coef": F.col("coef"), "coef": coef})
    return out.withColumn("intercept", F.col("intercept") - dot(F.col("coef"), means)).select(*kept, "scaled_coef")


def linear_score(names: list[str]) -> Column:
    return reduce(lambda total, at: total + F.col("coef")[at[0]] * F.col(f"`{at[1]}`"), enumerate(names), F.col("intercept"))


def fit_keys(panel: Panel, params: dict) -> tuple[str, ...]:
    """Keys that tell fits apart: none for one fit of all series, those of the series for one each."""
    scope = params.get("fit_scope", "pooled")
    if scope not in ("pooled", "series"):
        raise ValueError(f"fit_scope is 'pooled' or 'series', not {scope!r}")
    return panel.spec.keys if scope == "series" else ()
