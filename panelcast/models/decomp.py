"""Piecewise-linear trend, Fourier seasonality and lag regressors per series.

The model is that of Taylor and Letham (2018), fitted at its posterior mode. Every term is linear in the
coefficients, so one pass of sums of products per series holds all the data; the priors enter when the
small matrix is solved. A multiplicative model is fitted by alternating between trend and the rest.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import epoch_days
from ..operators.features import drop_incomplete
from ..plans.gram import FIT, dot, row_moments, symmetric
from ..plans.lineage import cut
from ..plans.ordered import Panel, add_lags, add_position
from ..spec import ModelSpec, parse_lags
from .base import Fitted, Ranges, as_forecast, fitted, importance_rows, kept, unfitted
from .bounds import around, interval_of
from .holidays import MARKS, Calendar, effect, set_sums, widened

# Fixed values of the published model: number of trend changes and the share of rows they lie in, prior
# scales of changes, slope and other terms, and per season its period in days and number of waves.
CHANGES, CHANGE_SHARE = 25, 0.8
CHANGE_SCALE, SLOPE_SCALE, TERM_SCALE = 0.05, 5.0, 10.0
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}

ROUNDS, TOLERANCE = 20, 1e-4
SOLVER_STEPS = 1000
SOLVER_TOLERANCE = 1e-6


def fit_decomp(panel: Panel, ranges: Ranges, model: ModelSpec) -> Fitted:
    """Params: ``yearly_seasonality`` (True), ``weekly_seasonality`` (True), ``daily_seasonality`` (False),
    ``seasonality_mode`` (additive or multiplicative), ``use_lag_regressors`` (True), ``lag_regressors``
    ([1, 7]), ``interval`` (none): bounds from the noise alone, ``rounds`` (20) and ``tolerance`` (1e-4 of the largest target) of the
    alternation of a multiplicative model. A series whose trend and terms no longer move leaves the alternation; ``Fitted.fits`` says which
    series ``converged``, and after how many ``rounds``.

    ``holidays`` (none) is a table as ``Calendar.of`` reads it. ``Fitted.effects`` gives what each adds to the target, or in a
    multiplicative model the share of the trend; a holiday without training rows adds nothing.

    Importance is the size of the standardised lag coefficients as shares of their sum.
    """
    params, spec, keys = model.params, panel.spec, panel.spec.keys
    mode = params.get("seasonality_mode", "additive")
    if mode not in ("additive", "multiplicative"):
        raise ValueError(f"seasonality_mode is 'additive' or 'multiplicative', not {mode!r}")
    default_on = {"yearly": True, "weekly": True, "daily": False}
    seasons = [SEASONS[name] for name, on in default_on.items() if params.get(f"{name}_seasonality", on)]
    lags = parse_lags(params.get("lag_regressors", [1, 7])) if params.get("use_lag_regressors", True) else []
    names = [f"target_lag_{k}" for k in lags]

    calendar = Calendar.of(params["holidays"]) if params.get("holidays") is not None else None
    holidays = calendar.names if calendar else []
    lagged = panel.on(add_lags(panel, {f"target_lag_{k}": (spec.target, k) for k in lags}))
    lagged = lagged.on(calendar.marked(lagged)) if calendar else lagged
    columns = [*keys, *spec.order, spec.target, *names, "range_id", *([MARKS] if calendar else [])]
    complete = drop_incomplete(ranges.rows(lagged, "train"), names).select(*dict.fromkeys(columns))
    terms, width = _terms(F.col(spec.date), seasons, names), _width(seasons, names)
    message = "No training data after filtering by date ranges"
    with kept(complete) as train:
        scales = fitted(_scales(train, panel, names), message)
        sequence = panel.on(panel.attach_to(train, scales), replace(spec, tiebreak=(*spec.tiebreak, "range_id")))
        scales = panel.attach_to(scales, _change_points(sequence))
        scales = cut(scales.withColumn("_hinges", F.coalesce("_hinges", F.array().cast("array<double>"))))
        rows = panel.attach_to(train, scales)
        y = F.col(spec.target) / F.col("_scale")
        if mode == "additive":
            fits = _solve(panel, rows, F.concat(_trend(spec.date), terms, F.array(y)), width, len(holidays))
            fits = fits.withColumns({"rounds": F.lit(1), "converged": F.col("solved")})
        else:
            rounds, tolerance = int(params.get("rounds", ROUNDS)), float(params.get("tolerance", TOLERANCE))
            fits = _alternated(panel, rows, terms, y, width, len(holidays), rounds, tolerance)
        fits = fitted(panel.attach_to(fits, scales), message)

    predict = drop_incomplete(ranges.rows(lagged, "predict"), names)
    scored = panel.attach_to(predict, fits).filter(F.col("coef").isNotNull())
    trend = _trend_value(spec.date)
    rest = dot(terms, F.slice("coef", CHANGES + 2, width - CHANGES - 2))
    rest = rest + effect(F.col("coef"), width - 1) if calendar else rest
    value = trend + rest if mode == "additive" else trend * (1 + rest)
    importance = None
    if names:
        sizes = F.transform(F.slice("coef", width - len(names), len(names)), F.abs)
        total = F.aggregate(sizes, F.lit(0.0), lambda a, b: a + b)
        shares = fits.withColumn("_share", F.transform(sizes, lambda s: F.try_divide(s, total)))
        importance = importance_rows(shares, keys, model, names, "_share")
    skipped = unfitted(panel.df.select(*keys).distinct(), fits, keys, message) if keys else None
    bounds = around(value * F.col("_scale"), F.sqrt("noise") * F.col("_scale"), interval_of(model))
    forecast = as_forecast(scored, panel, model, value * F.col("_scale"), bounds)
    effects = None
    if calendar:
        unit = F.col("_scale") if mode == "additive" else F.lit(1.0)
        found = F.arrays_zip(F.array(*map(F.lit, holidays)).cast("array<string>").alias("holiday"), F.slice("coef", width, max(len(holidays), 1)).alias("effect"))
        listed = fits.select(*keys, unit.alias("_unit"), F.explode(found).alias("_h"))
        effects = listed.select(*keys, F.col("_h.holiday").alias("holiday"), (F.col("_h.effect") * F.col("_unit")).alias("effect"))
    states = fits.select(*keys, "rounds", "converged")
    return Fitted(model, forecast, importance=importance, skipped=skipped, fits=states, effects=effects)


def _alternated(
    panel: Panel, rows: DataFrame, terms: Column, y: Column, width: int, holidays: int, rounds: int, tolerance: float
) -> DataFrame:
    """Fits of a multiplicative model: the terms times the last round's trend are fitted beside a new trend, until nothing moves.

    Series that have settled keep their coefficients and take no part in later rounds.
    """
    keys, date = panel.spec.keys, panel.spec.date
    first = _solve(panel, rows, F.concat(_trend(date), F.array(y)), CHANGES + 2)
    padded = F.concat("coef", F.array_repeat(F.lit(0.0), width - CHANGES - 2 + holidays))
    state = cut(first.withColumns({"coef": padded, "rounds": F.lit(0), "converged": F.lit(False)}))
    for number in range(1, rounds + 1):
        going = state.filter(~F.col("converged"))
        if going.isEmpty():
            break
        by_trend = panel.attach_to(rows, going).filter(F.col("coef").isNotNull()).withColumn("_g", _trend_value(date))
        scaled = F.transform(terms, lambda x: x * F.col("_g"))
        fresh = _solve(panel, by_trend, F.concat(_trend(date), scaled, F.array(y)), width, holidays, F.col("_g"))
        last = going.select(*keys, F.col("coef").alias("_last"), F.col("intercept").alias("_at"))
        moved = F.array_max(F.zip_with("coef", "_last", lambda a, b: F.abs(a - b)))
        settled = (F.greatest(moved, F.abs(F.col("intercept") - F.col("_at"))) <= tolerance) & F.col("solved")
        fresh = panel.attach_to(fresh, last).withColumns({"rounds": F.lit(number), "converged": settled}).drop("_last", "_at")
        state = cut(state.filter("converged").unionByName(fresh))
    return state


def _scales(train: DataFrame, panel: Panel, names: list[str]) -> DataFrame:
    """Per series: rows, time span in days, largest target, and mean and deviation of each regressor."""
    day, y = epoch_days(F.col(panel.spec.date)), F.col(panel.spec.target)
    spread = [F.coalesce(F.nullif(F.stddev_samp(name), F.lit(0.0)), F.lit(1.0)) for name in names]
    return (
        train.groupBy(*panel.spec.keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(day).alias("_from"),
            F.coalesce(F.nullif(F.max(day) - F.min(day), F.lit(0.0)), F.lit(1.0)).alias("_span"),
            F.coalesce(F.nullif(F.max(F.abs(y)), F.lit(0.0)), F.lit(1.0)).alias("_scale"),
            F.array(*[F.avg(name) for name in names]).cast("array<double>").alias("_means"),
            F.array(*spread).cast("array<double>").alias("_spreads"),
        )
        .filter(F.col("_n") > 0)
    )


def _change_points(train: Panel) -> DataFrame:
    """Scaled times of up to 25 evenly placed rows among the first 80 % of a series' training rows."""
    placed = add_position(train, "_at")
    last = F.floor(F.col("_n") * CHANGE_SHARE) - 1
    changes = F.least(F.lit(CHANGES), last)
    at = F.col("_at") - 1
    nearest = F.bround(at * changes / last)
    chosen = (changes > 0) & (nearest >= 1) & (nearest <= changes) & (F.bround(nearest * last / changes) == at)
    time = _time(train.spec.date)
    hinges = F.sort_array(F.collect_list(F.when(chosen, time))).alias("_hinges")
    return placed.filter((last > 0)).filter(chosen).groupBy(*train.spec.keys).agg(hinges)


def _time(date: str) -> Column:
    return (epoch_days(F.col(date)) - F.col("_from")) / F.col("_span")


def _trend(date: str) -> Column:
    """Time and its hinges; a series with fewer changes has zeros in the free places."""
    hinges = F.transform("_hinges", lambda at: F.greatest(_time(date) - at, F.lit(0.0)))
    free = F.array_repeat(F.lit(0.0), F.lit(CHANGES) - F.size("_hinges"))
    return F.concat(F.array(_time(date)), hinges, free)


def _trend_value(date: str) -> Column:
    return F.col("intercept") + dot(_trend(date), F.slice("coef", 1, CHANGES + 1))


def _terms(date: Column, seasons: list[tuple[float, int]], names: list[str]) -> Column:
    """Sine and cosine waves of each season, then the standardised regressors."""
    waves = []
    for period, count in seasons:
        for k in range(1, count + 1):
            angle = F.lit(2 * np.pi * k / period) * epoch_days(date)
            waves += [F.sin(angle), F.cos(angle)]
    regressors = [(F.col(name) - F.col("_means")[i]) / F.col("_spreads")[i] for i, name in enumerate(names)]
    return F.array(*waves, *regressors).cast("array<double>")


def _width(seasons: list[tuple[float, int]], names: list[str]) -> int:
    return 1 + CHANGES + sum(2 * count for _, count in seasons) + len(names) + 1


def _solve(panel: Panel, rows: DataFrame, row: Column, width: int, holidays: int = 0, size: Column | None = None) -> DataFrame:
    """Fits of rows of features and target, and of holidays that are worth ``size`` (1) on their days."""
    keys = panel.spec.keys
    sums = row_moments(rows, keys, row, width).filter(F.col("n") > 0)
    if not holidays:
        return sums.withColumn("_fit", _mode("n", "mean", "products")).select(*keys, "_fit.*")
    sets = set_sums(rows, keys, row, width, F.lit(1.0) if size is None else size)
    wide = panel.attach_to(sums, sets)
    return wide.withColumn("_fit", _mode_with(holidays)("n", "mean", "products", "_sets")).select(*keys, "_fit.*")


MODE = T.StructType([*FIT.fields, T.StructField("noise", T.DoubleType()), T.StructField("solved", T.BooleanType())])


def posterior_mode(n: int, mean: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ``solved_mode``."""
    return solved_mode(n, mean, products)[:2]


def solved_mode(n: int, mean: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, float, float, bool]:
    """Mode under normal priors, and double-exponential ones on trend changes, with free intercept.

    The double-exponential prior is met by a normal one whose scale follows the last estimate; the noise
    follows from the residual sum of squares. Coefficients, intercept, the noise's variance, and whether the steps came to rest
    within ``SOLVER_STEPS``.
    """
    g = symmetric(products, len(mean))
    gram, cross, total = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    scale = np.full(len(gram), TERM_SCALE)
    scale[0] = SLOPE_SCALE
    changes = slice(1, 1 + CHANGES)
    penalty, noise = 1 / scale**2, max(total / n, 1e-12)
    penalty[changes] = 1 / CHANGE_SCALE**2
    coef, solved = np.zeros(len(gram)), False
    for _ in range(SOLVER_STEPS):
        before = coef
        coef = np.linalg.solve(gram + noise * np.diag(penalty) + 1e-12 * np.eye(len(gram)), cross)
        left = total - 2 * coef @ cross + coef @ gram @ coef
        noise = max(left / n, 1e-12)
        penalty[changes] = 1 / (CHANGE_SCALE * np.maximum(np.abs(coef[changes]), 1e-8))
        solved = bool(np.abs(coef - before).max() < SOLVER_TOLERANCE)
        if solved:
            break
    return coef, float(mean[-1] - coef @ mean[:-1]), float(noise), solved


@F.pandas_udf(MODE)
def _mode(n: pd.Series, mean: pd.Series, products: pd.Series) -> pd.DataFrame:
    rows = zip(n, map(np.asarray, mean), map(np.asarray, products))
    return pd.DataFrame([solved_mode(*row) for row in rows], columns=["coef", "intercept", "noise", "solved"])


def _mode_with(holidays: int):
    @F.pandas_udf(MODE)
    def mode(n: pd.Series, mean: pd.Series, products: pd.Series, sets: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for count, m, cells, marks, sums in zip(n, map(np.asarray, mean), map(np.asarray, products), sets["marks"], sets["sums"]):
            rows.append(solved_mode(count, *widened(count, m, cells, marks, sums, holidays)))
        return pd.DataFrame(rows, columns=["coef", "intercept", "noise", "solved"])

    return mode
