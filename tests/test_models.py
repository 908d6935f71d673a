"""Models against plain numpy on small series."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from itertools import combinations
from math import factorial

import data
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.models import arima, decomp
from panelcast.models.base import FixedRanges
from panelcast.models.gbt import fit_gbt
from panelcast.models.lag import fit_lag
from panelcast.models.ols import fit_ols
from panelcast.operators import attribution
from panelcast.operators.evaluate import metrics, top_importance
from panelcast.plans.gram import least_squares, moments, regressions, row_moments
from panelcast.plans.ordered import Panel
from panelcast.run import run_models, train_models
from panelcast.sources.files import write_forecast_csv
from panelcast.spec import DateRange, Exogenous, FeatureConfig, ModelSpec, SeriesSpec, Temporal

SPEC = SeriesSpec("ds", "y", ("key",))
RANGES = FixedRanges([DateRange("2020-01-01", "2021-12-31")], [DateRange("2021-12-31", "2022-03-31"), DateRange("2022-02-01", "2022-02-10")])


@pytest.fixture(scope="module")
def series():
    return {"a": data.wave(830, 1), "b": data.wave(830, 2, 1000.0), None: data.wave(830, 3, 5.0)}


@pytest.fixture(scope="module")
def panel(spark, series):
    df = spark.createDataFrame(data.panel_rows(series), data.SCHEMA)
    return Panel.of(df.withColumn("x", F.sin(F.col("y"))).persist(), SPEC)


def frame(series) -> pd.DataFrame:
    out = pd.DataFrame(data.panel_rows(series), columns=["key", "ds", "y"])
    out["key"] = out["key"].fillna("-")
    return out


def lags(df: pd.DataFrame, ks) -> pd.DataFrame:
    for k in ks:
        df[f"l{k}"] = df.groupby("key")["y"].shift(k)
    return df


def predicted(fit) -> pd.DataFrame:
    out = fit.forecast.withColumn("key", F.coalesce("key", F.lit("-"))).toPandas()
    return out.sort_values(["key", "range_id", "ds"]).reset_index(drop=True)


def in_predict(df: pd.DataFrame) -> pd.DataFrame:
    parts = [df[df.ds.between("2021-12-31", "2022-03-31")].assign(r=0), df[df.ds.between("2022-02-01", "2022-02-10")].assign(r=1)]
    return pd.concat(parts).sort_values(["key", "r", "ds"]).reset_index(drop=True)


def in_train(df: pd.DataFrame) -> pd.DataFrame:
    return df[df.ds.between("2020-01-01", "2021-12-31")]


# --- linear regression --------------------------------------------------------------------------


def numpy_ols(df, names, pooled):
    rows, out = in_predict(df), []
    for _, part in [(None, df)] if pooled else df.groupby("key"):
        train = in_train(part).dropna()
        x = np.column_stack([np.ones(len(train)), train[names]])
        beta = np.linalg.lstsq(x, train["y"], rcond=None)[0]
        score = rows if pooled else rows[rows.key == part.key.iloc[0]]
        out.append(pd.Series(np.column_stack([np.ones(len(score)), score[names]]) @ beta, index=score.index))
    return pd.concat(out).sort_index()


@pytest.mark.parametrize("scope", ["pooled", "series"])
@pytest.mark.parametrize("ks", [[1, 7], list(range(1, 16))])
@pytest.mark.parametrize("task_rows", [1_000_000, 300])
def test_ols_equals_numpy(panel, series, scope, ks, task_rows):
    """Narrow and wide sets of features, short and long series."""
    model = ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": ks, "fit_scope": scope})
    got = predicted(fit_ols(replace(panel, task_rows=task_rows), RANGES, model))
    df = lags(frame(series), ks)
    want = numpy_ols(df, [f"l{k}" for k in ks], scope == "pooled")
    assert np.allclose(got.prediction, want, rtol=1e-8)
    assert np.allclose(got.actual, in_predict(df).y)


def test_ols_options_agree(panel):
    """Standardising changes no prediction, and neither does a residual of a lag among the features."""
    base = predicted(fit_ols(panel, RANGES, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1, 7]})))
    for extra in ({"standardize": True}, {"target_mode": "residual"}, {"target_mode": "residual", "residual_lag": 7, "standardize": True}):
        other = predicted(fit_ols(panel, RANGES, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1, 7], **extra})))
        assert np.allclose(base.prediction, other.prediction, rtol=1e-7)


def test_ols_importance(panel):
    plain = fit_ols(panel, RANGES, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1]})).importance.first()
    scaled = fit_ols(panel, RANGES, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1], "standardize": True})).importance.first()
    std = panel.df.filter("ds < '2021-12-31'").agg(F.stddev_pop("y")).first()[0]
    assert scaled["importance"] == pytest.approx(plain["importance"] * std, rel=1e-3)


def test_no_training_rows(panel):
    far = FixedRanges([DateRange("1990-01-01", "1990-02-01")], RANGES._ranges["predict"])
    model = ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1]})
    with pytest.raises(ValueError, match="Not enough data after creating features"):
        fit_ols(panel, far, model)
    with pytest.raises(ValueError, match="Not enough data after creating features"):
        fit_ols(panel, far, replace(model, params={"lags": [1], "standardize": True, "fit_scope": "series"}))
    with pytest.raises(ValueError, match="No training data after filtering"):
        decomp.fit_decomp(panel, far, replace(model, params={}))
    with pytest.raises(ValueError, match=r"Not enough training data for ARIMA\(1,1,1\)"):
        arima.fit_arima(panel, far, replace(model, params={}))


def test_least_squares_of_dependent_columns():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 1))
    x = np.hstack([a, 2 * a, np.full((50, 1), 3.0), 1e6 * rng.normal(size=(50, 1))])
    y = x @ [1, 0, 0, 1e-6] + rng.normal(size=50)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(least_squares(xc.T @ xc, xc.T @ yc), np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-6)


@pytest.mark.parametrize("constant", [True, False])
def test_fits_together_equal_fits_alone(constant):
    """Full rank, dependent, constant and single columns in one batch."""
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(30, 4)) * [1, 1e5, 1, 3] + [5, 0, 1, 0] for _ in range(5)]
    tables[1][:, 1] = 2 * tables[1][:, 0]
    tables[2][:, 2] = 7.0
    mean = np.stack([t.mean(0) for t in tables])
    products = np.stack([((t - t.mean(0)).T @ (t - t.mean(0)))[np.triu_indices(4)] for t in tables])
    coef, intercept = regressions(np.full(5, 30), mean, products, constant)
    for i, t in enumerate(tables):
        x = t[:, :3] - t[:, :3].mean(0) if constant else t[:, :3]
        want = np.linalg.lstsq(x, t[:, 3] - (t[:, 3].mean() if constant else 0), rcond=None)[0]
        assert np.allclose(coef[i], want, rtol=1e-6, atol=1e-12)
        assert intercept[i] == pytest.approx(t[:, 3].mean() - want @ t[:, :3].mean(0) if constant else 0.0)
    assert regressions(np.array([3]), np.array([[2.0]]), np.array([[1.0]]), constant)[0].shape == (1, 0)


def test_moments_by_aggregates_and_by_batches(panel):
    by_aggregate = moments(panel.df, ("key",), ["y", "x"]).orderBy("key").collect()
    by_batch = row_moments(panel.df, ("key",), F.array("y", "x"), 2).orderBy("key").collect()
    for a, b in zip(by_aggregate, by_batch, strict=True):
        assert a["n"] == b["n"] and np.allclose(a["mean"], b["mean"]) and np.allclose(a["products"], b["products"], rtol=1e-6)


# --- ARIMA --------------------------------------------------------------------------------------


def numpy_arima(y, p, d, q, steps, stages=3):
    """The regressions, then one step after another."""
    n, centre = len(y), y.mean()
    w = np.diff(y - centre, n=d)
    constant = d == 0

    def regress(target, columns):
        x = np.column_stack([*columns, *([np.ones(len(target))] if constant else [])])
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        return beta[: len(columns)], beta[-1] if constant else 0.0

    e = np.zeros(len(w))
    start = p
    if q:
        m = max(p + q + 1, int(min(20, round(10 * np.log10(n)), n // 4)))
        beta, c = regress(w[m:], [w[m - i : -i] for i in range(1, m + 1)])
        e[m:] = w[m:] - c - sum(b * w[m - i : -i] for i, b in enumerate(beta, 1))
        start = m + q
    beta, c = regress(w[start:], [w[start - i : len(w) - i] for i in range(1, p + 1)] + [e[start - j : len(w) - j] for j in range(1, q + 1)])
    ar, ma = beta[:p], beta[p:]
    if q and stages > 2:
        ma = arima.invertible(ma)

        def followed(values, ma):
            out = []
            for value in values:
                out.append(value - sum(t * out[-j] for j, t in enumerate(ma, 1) if j <= len(out)))
            return np.array(out)

        def residuals(ar, ma, c):
            return followed(w[p:] - c - sum((a * w[p - i : len(w) - i] for i, a in enumerate(ar, 1)), np.zeros(len(w) - p)), ma)

        def late(values, k):
            return np.concatenate([np.zeros(k), values[: len(values) - k]])

        now = residuals(ar, ma, c)
        x, v = followed(w[p:], ma), followed(now, ma)
        delta, shift = regress(now, [late(x, i) for i in range(1, p + 1)] + [late(v, j) for j in range(1, q + 1)])
        if np.abs(np.roots(np.concatenate([[1.0], ma + delta[p:]]))).max() < 1:
            ar, ma, c = ar + delta[:p], ma + delta[p:], c + shift * (1 + ma.sum())
        e = np.concatenate([np.zeros(p), residuals(ar, ma, c)])
    ws, es = list(w), list(e)
    levels = [np.diff(y - centre, n=k)[-1] for k in range(d)]
    out = []
    for _ in range(steps):
        nxt = c + sum(a * ws[-i] for i, a in enumerate(ar, 1)) + sum(b * es[-j] for j, b in enumerate(ma, 1))
        ws.append(nxt)
        es.append(0.0)
        value = nxt
        for k in range(d - 1, -1, -1):
            levels[k] += value
            value = levels[k]
        out.append(value + centre)
    return np.array(out)


@pytest.mark.parametrize("stages", [2, 3])
@pytest.mark.parametrize("order", [(1, 1, 1), (2, 0, 2), (1, 1, 0), (0, 1, 1), (2, 2, 1), (3, 0, 0)])
def test_arima_equals_numpy(panel, series, order, stages):
    if stages == 2 and not order[2]:
        pytest.skip("two stages are all there is without a moving average")
    model = ModelSpec("m", "ARIMA", "M", {**dict(zip("pdq", order)), "stages": stages})
    got = predicted(arima.fit_arima(panel, RANGES, model))
    for key, values in series.items():
        train = values[:731]
        want = numpy_arima(train, *order, 91, stages)
        part = got[got.key == (key or "-")]
        assert np.allclose(part[part.range_id == 0].prediction, want, rtol=1e-6)
        # Every range starts again after the end of training.
        assert np.allclose(part[part.range_id == 1].prediction, want[:10], rtol=1e-6)


def numpy_seasonal(y, order, season, steps):
    """Free search for the tied coefficients, then one step after another."""
    (p, d, _), (big_p, big_d, _, s) = order, season
    centre = y.mean()
    w = y - centre
    for lag in [1] * d + [s] * big_d:
        w = w[lag:] - w[:-lag]
    constant = d + big_d == 0

    def polynomials(beta):
        ar, big = np.zeros(p + 1), np.zeros(big_p * s + 1)
        ar[0] = big[0] = 1.0
        ar[1:], big[s::s] = -beta[:p], -beta[p : p + big_p]
        return ar, big

    def residuals(beta):
        return np.convolve(w, np.convolve(*polynomials(beta)), "valid") - (beta[-1] if constant else 0.0)

    beta = np.zeros(p + big_p + constant)
    for _ in range(200 if len(beta) else 0):
        slopes = np.column_stack([(residuals(beta + h) - residuals(beta - h)) / 2e-4 for h in np.eye(len(beta)) * 1e-4])
        step = np.linalg.lstsq(slopes, -residuals(beta), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    # Explosive roots are reflected, and the constant goes with them.
    beta[:p], beta[p : p + big_p] = arima._stationary(beta[:p]), arima._stationary(beta[p : p + big_p])
    if constant:
        beta[-1] += residuals(beta).mean()
    full = np.convolve(*polynomials(beta))
    for lag in [1] * d + [s] * big_d:
        full = np.convolve(full, np.r_[1.0, np.zeros(lag - 1), -1.0])
    out = list(y - centre)
    for _ in range(steps):
        out.append((beta[-1] if constant else 0.0) - sum(c * out[-k] for k, c in enumerate(full[1:], 1)))
    return np.array(out[len(y) :]) + centre


SEASONAL = [((1, 0, 0), (1, 0, 0, 7)), ((0, 1, 0), (0, 1, 0, 7)), ((2, 1, 0), (1, 0, 0, 7)), ((1, 0, 0), (2, 1, 0, 5)), ((7, 0, 0), (1, 0, 0, 7))]


@pytest.mark.parametrize("order, season", SEASONAL)
def test_seasonal_arima_equals_numpy(panel, series, order, season):
    model = ModelSpec("m", "ARIMA", "M", {**dict(zip("pdq", order)), "seasonal_order": season})
    got = predicted(arima.fit_arima(panel, RANGES, model))
    for key, values in series.items():
        want = numpy_seasonal(values[:731], order, season, 91)
        part = got[got.key == (key or "-")]
        assert np.allclose(part[part.range_id == 0].prediction, want, rtol=1e-6)
        assert np.allclose(part[part.range_id == 1].prediction, want[:10], rtol=1e-6)


def test_seasonal_arima_on_long_series(panel):
    params = {"p": 1, "d": 0, "q": 1, "seasonal_order": [0, 1, 1, 7], "interval": 0.9}
    model = ModelSpec("m", "ARIMA", "M", params)
    short, long = (predicted(arima.fit_arima(replace(panel, task_rows=k), RANGES, model)) for k in (10_000, 300))
    names = ["prediction", "lower", "upper"]
    assert np.allclose(short[names], long[names], rtol=1e-9) and (short.lower < short.upper).all()


def test_seasonal_moving_average_is_recovered(spark):
    """(1 + 0.4 B)(1 + 0.5 B^4) with a seasonal difference: the forecasts and their bounds know the season."""
    e = np.random.default_rng(5).normal(size=6000)
    w = np.convolve(e, np.convolve([1, 0.4], [1, 0, 0, 0, 0.5]), "valid")
    y = np.zeros(len(w))
    for t in range(len(w)):
        y[t] = w[t] + (y[t - 4] if t >= 4 else 0.0)
    df = spark.createDataFrame(data.panel_rows({"a": y}), data.SCHEMA)
    days = [r["ds"] for r in df.orderBy("ds").collect()]
    ranges = FixedRanges([DateRange(str(days[0]), str(days[-21]))], [DateRange(str(days[-20]), str(days[-1]))])
    params = {"p": 0, "d": 0, "q": 1, "seasonal_order": (0, 1, 1, 4), "interval": 0.9}
    got = predicted(arima.fit_arima(Panel.of(df, SPEC), ranges, ModelSpec("m", "ARIMA", "M", params)))
    train = np.convolve([1, 0.4], [1, 0, 0, 0, 0.5])
    psi = np.convolve(train, np.tile([1, 0, 0, 0], 5))[:20]
    reach = (got.upper - got.lower) / 2
    assert np.allclose(reach, 1.6448536 * np.sqrt(np.cumsum(psi**2)), rtol=0.08)
    # Beyond the moving average's reach a forecast repeats the season before.
    assert np.allclose(got.prediction[9:20], got.prediction[5:16])


@pytest.mark.parametrize("season", [(1, 0, 0), (1, 0, 0, 1), (-1, 0, 0, 7)])
def test_seasonal_orders_that_make_no_sense(panel, season):
    with pytest.raises(ValueError, match="seasonal_order"):
        arima.fit_arima(panel, RANGES, ModelSpec("m", "ARIMA", "M", {"seasonal_order": season}))


def test_arima_on_long_series(panel):
    model = ModelSpec("m", "ARIMA", "M", {"p": 2, "d": 1, "q": 1})
    short, long = (predicted(arima.fit_arima(replace(panel, task_rows=k), RANGES, model)) for k in (10_000, 300))
    assert np.allclose(short.prediction, long.prediction, rtol=1e-9)


@pytest.mark.parametrize("order", [(0, 1, 1), (1, 0, 2)])
def test_one_block_and_many(panel, order):
    model = ModelSpec("m", "ARIMA", "M", {**dict(zip("pdq", order)), "interval": 0.8})
    one, many = (predicted(arima.fit_arima(replace(panel, task_rows=k), RANGES, model)) for k in (10_000, 97))
    assert np.allclose(one[["prediction", "lower", "upper"]], many[["prediction", "lower", "upper"]], rtol=1e-9)


def test_refinement_comes_closer():
    """Estimates of many short series lie nearer to the truth after the third regression."""
    rng, apart = np.random.default_rng(11), {2: [], 3: []}
    for _ in range(60):
        e = rng.normal(size=251)
        w = e[1:] + 0.75 * e[:-1]
        for stages in apart:
            # One step ahead of a moving average is theta times the last residual.
            apart[stages].append(numpy_arima(w, 0, 0, 1, 1, stages)[0] - w.mean() - 0.75 * e[-1])
    assert np.std(apart[3]) < np.std(apart[2])


def test_variances_equal_steps():
    step = arima.transition(np.array([0.5, -0.3, 0.4]), 0.2, 2, 1, 1)
    impulse = np.array([1.0, 0.0, 1.0, 1.0, 0.0])
    total, now = np.zeros((5, 5)), impulse
    for h in range(1, 40):
        total = total + np.outer(now, now)
        now = step @ now
        assert np.allclose(arima.variances(step, impulse, np.array([3, h]))[1], total)


def test_arima_recovers_its_coefficients(spark):
    rng = np.random.default_rng(5)
    e, y = rng.normal(size=4000), np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    step = arima.transition(np.array([0.7, 0.4]), 0.0, 1, 0, 1)
    df = spark.createDataFrame(data.panel_rows({"a": y}), data.SCHEMA)
    ranges = FixedRanges([DateRange("2020-01-01", "2030-12-13")], [DateRange("2030-12-13", "2030-12-13")])
    fit = arima.fit_arima(Panel.of(df, SPEC), ranges, ModelSpec("m", "ARIMA", "M", {"p": 1, "d": 0, "q": 1}))
    exact = arima.powers_applied(step, np.array([y[-1], e[-1], 1.0]), np.array([1]))[0, 0]
    assert fit.forecast.first()["prediction"] == pytest.approx(exact, abs=0.15)


def test_short_series_are_listed(spark, series):
    short = {**series, "tiny": np.arange(7.0)}
    panel = Panel.of(spark.createDataFrame(data.panel_rows(short), data.SCHEMA), SPEC)
    fit = arima.fit_arima(panel, RANGES, ModelSpec("m", "ARIMA", "M"))
    assert [(r["key"], r["reason"]) for r in fit.skipped.collect()] == [("tiny", "Not enough training data for ARIMA(1,1,1)")]
    assert fit.forecast.filter("key = 'tiny'").count() == 0
    # Long enough by the count of rows, but none of them has all the lags of both regressions.
    short = {**series, "tiny": np.arange(20.0)}
    panel = Panel.of(spark.createDataFrame(data.panel_rows(short), data.SCHEMA), SPEC)
    fit = arima.fit_arima(panel, RANGES, ModelSpec("m", "ARIMA", "M", {"p": 10, "d": 0, "q": 5}))
    assert [r["key"] for r in fit.skipped.collect()] == ["tiny"]
    short = {**series, "tiny": np.arange(3.0)}
    panel = Panel.of(spark.createDataFrame(data.panel_rows(short), data.SCHEMA), SPEC)
    fit = fit_ols(panel, RANGES, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [7], "fit_scope": "series"}))
    assert [r["key"] for r in fit.skipped.collect()] == ["tiny"]


def test_explosive_roots_are_reflected():
    ar = arima._stationary(np.array([1.5]))
    assert abs(ar[0]) < 1
    assert np.allclose(arima._stationary(np.array([0.5, 0.2])), [0.5, 0.2])


# --- decomposition ------------------------------------------------------------------------------


def numpy_decomp(values, names_on, predict_rows, marks=None):
    """The additive model on one series, with the solver of the library but a design of its own."""
    df = pd.DataFrame({"y": values})
    df["day"] = (datetime(2020, 1, 1) - datetime(1970, 1, 1)).days + np.arange(len(df))
    for k in names_on:
        df[f"l{k}"] = df.y.shift(k)
    train = df.iloc[:731].dropna()
    names = [f"l{k}" for k in names_on]
    low, span, scale = train.day.min(), train.day.max() - train.day.min(), train.y.abs().max()
    size = int(np.floor(len(train) * 0.8))
    at = np.linspace(0, size - 1, min(25, size - 1) + 1).round().astype(int)[1:]
    hinges = ((train.day - low) / span).to_numpy()[at]

    def design(rows):
        t = ((rows.day - low) / span).to_numpy()
        columns = [t, *[np.maximum(t - h, 0) for h in hinges]]
        for period, count in ((365.25, 10), (7.0, 3)):
            for k in range(1, count + 1):
                columns += [np.sin(2 * np.pi * k * rows.day / period), np.cos(2 * np.pi * k * rows.day / period)]
        columns += [(rows[n] - train[n].mean()) / train[n].std() for n in names]
        columns += [np.isin(rows.day, days).astype(float) for days in marks or ()]
        return np.column_stack(columns)

    z = np.column_stack([design(train), train.y / scale])
    centred = z - z.mean(0)
    products = (centred.T @ centred)[np.triu_indices(z.shape[1])]
    coef, intercept = decomp.posterior_mode(len(z), z.mean(0), products)
    return (design(df.iloc[predict_rows]) @ coef + intercept) * scale


# Holidays of the tests, two of them on one day, one never in training.
FEASTS = [("fair", "2020-05-04", -1, 1), ("fair", "2021-05-04", -1, 1), ("sale", "2020-11-27", 0, 0), ("sale", "2021-05-04", None, None),
          ("sale", "2021-05-04", None, None), ("sale", "2022-01-20", 0, 0), ("new", "2022-02-02", 0, 0), (None, "2021-01-01", 0, 0)]


def feasts(spark):
    return spark.createDataFrame(FEASTS, "holiday string, date string, lower_window int, upper_window int")


def epoch(*days):
    return [(datetime.fromisoformat(day) - datetime(1970, 1, 1)).days for day in days]


@pytest.mark.parametrize("task_rows", [10_000, 300])
def test_holidays_equal_columns_of_their_own(spark, panel, series, task_rows):
    params = {"use_lag_regressors": False, "holidays": feasts(spark)}
    fit = decomp.fit_decomp(replace(panel, task_rows=task_rows), RANGES, ModelSpec("m", "PROPHET", "M", params))
    got = predicted(fit)
    fair = epoch("2020-05-04", "2021-05-04")
    days = [fair, [d + 1 for d in fair], [d - 1 for d in fair], epoch("2022-02-02"), epoch("2020-11-27", "2021-05-04", "2022-01-20")]
    for key, values in series.items():
        part = got[(got.key == (key or "-")) & (got.range_id == 0)]
        assert np.allclose(part.prediction, numpy_decomp(values, [], slice(730, 821), days), rtol=1e-5)
    effects = {(r["key"], r["holiday"]): r["effect"] for r in fit.effects.collect()}
    assert sorted(name for key, name in effects if key == "a") == ["fair", "fair_+1", "fair_-1", "new", "sale"]
    assert all(value == 0 for (_, name), value in effects.items() if name == "new")


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_holiday_effect_is_found(spark, mode):
    """Without noise the effect planted comes back, and goes into the forecast."""
    days = pd.date_range("2020-01-01", periods=830)
    off = days.strftime("%m-%d").isin(["03-03", "06-06", "09-09", "01-15"])
    trend = 100 + 0.05 * np.arange(830)
    y = trend + 20 * off if mode == "additive" else trend * (1 + 0.2 * off)
    panel = Panel.of(spark.createDataFrame(data.panel_rows({"a": y}), data.SCHEMA), SPEC)
    table = spark.createDataFrame([("feast", d.date()) for d in days[off]], "holiday string, date date")
    off_params = {"yearly_seasonality": False, "weekly_seasonality": False, "use_lag_regressors": False}
    fit = decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", {**off_params, "seasonality_mode": mode, "holidays": table}))
    assert fit.effects.first()["effect"] == pytest.approx(20.0 if mode == "additive" else 0.2, rel=0.01)
    part = predicted(fit)
    assert np.allclose(part[part.range_id == 0].prediction, y[730:821], rtol=5e-3)


def test_calendar_without_days(spark, panel):
    params = {"use_lag_regressors": False, "yearly_seasonality": False}
    plain = predicted(decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", params)))
    none = decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", {**params, "holidays": feasts(spark).limit(0)}))
    assert np.allclose(plain.prediction, predicted(none).prediction) and none.effects.count() == 0
    with pytest.raises(ValueError, match="no column date"):
        decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", {"holidays": feasts(spark).drop("date")}))


@pytest.mark.parametrize("lag_list", ["1, 7", None])
def test_decomposition_equals_numpy(panel, series, lag_list):
    params = {"lag_regressors": lag_list} if lag_list else {"use_lag_regressors": False}
    fit = decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", params))
    got = predicted(fit)
    for key, values in series.items():
        want = numpy_decomp(values, [1, 7] if lag_list else [], slice(730, 821))
        part = got[(got.key == (key or "-")) & (got.range_id == 0)]
        assert np.allclose(part.prediction, want, rtol=1e-5)
    if lag_list:
        totals = fit.importance.groupBy("key").agg(F.sum("importance").alias("s")).collect()
        assert all(r["s"] == pytest.approx(1.0) for r in totals)
    else:
        assert fit.importance is None


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_decomposition_follows_trend_and_season(panel, series, mode):
    params = {"use_lag_regressors": False, "seasonality_mode": mode}
    got = predicted(decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", params)))
    errors = (got.prediction - got.actual)[got.key == "a"]
    assert np.sqrt((errors**2).mean()) < 6
    assert got.prediction.notna().all()


def test_posterior_mode_meets_its_conditions():
    """At the mode the gradient of the penalised fit vanishes, or lies within the kink of the prior."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1 + decomp.CHANGES + 4))
    y = x @ np.r_[1.0, np.where(rng.random(decomp.CHANGES) < 0.2, 0.5, 0.0), 0.3, -0.2, 0.1, 0.0] + rng.normal(0, 0.2, 400)
    z = np.column_stack([x, y])
    c = z - z.mean(0)
    g = c.T @ c
    coef, _ = decomp.posterior_mode(len(z), z.mean(0), g[np.triu_indices(z.shape[1])])
    left = g[-1, -1] - 2 * coef @ g[:-1, -1] + coef @ g[:-1, :-1] @ coef
    slope = (g[:-1, -1] - g[:-1, :-1] @ coef) / (left / len(z))
    changes = slice(1, 1 + decomp.CHANGES)
    big = np.abs(coef[changes]) > 1e-3
    assert np.allclose(slope[changes][big], np.sign(coef[changes][big]) / decomp.CHANGE_SCALE, rtol=0.02)
    assert (np.abs(slope[changes][~big]) <= 1.05 / decomp.CHANGE_SCALE).all()


# --- boosted trees ------------------------------------------------------------------------------

GBT = ModelSpec(
    "g", "XGBOOST", "G",
    {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.5, "feature_config": FeatureConfig([1, 7], Temporal(day_of_week=True), [Exogenous("x", [1], True)])},
)


@pytest.fixture(scope="module")
def boosted(panel):
    return fit_gbt(panel, RANGES, GBT)


def test_boosted_trees(boosted, series):
    rows = boosted.importance.collect()
    assert [r["feature"] for r in rows] == ["target_lag_1", "target_lag_7", "dow_sin", "dow_cos", "x_lag_1", "x_actual"]
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    got = predicted(boosted)
    assert len(got) == 3 * (91 + 10)
    assert metrics(boosted.forecast).first()["r2"] > 0.9


def test_boosting_takes_tasks_by_rows(spark):
    """However many tasks made the training rows, a few rows are one task, in a fixed order."""
    from panelcast.models.gbt import FIT_ROWS, spread

    rows = spark.range(1000).select((F.col("id") % 3).alias("key"), F.col("id").alias("ds")).repartition(50)
    few = spread(rows, 1000, ("key", "ds"))
    assert few.rdd.getNumPartitions() == 1 and few.collect() == rows.orderBy("key", "ds").collect()
    assert spread(rows, 2 * FIT_ROWS + 1, ("key", "ds")).rdd.getNumPartitions() == 3


def test_attributions_add_up(panel, boosted):
    """Base and attributions of a training row sum to the model's prediction for it."""
    same = FixedRanges(RANGES._ranges["train"], RANGES._ranges["train"])
    scored = fit_gbt(panel, same, GBT)
    names = [r["feature"] for r in scored.importance.collect()]
    total = sum((F.col(n) for n in names), F.col("base"))
    sums = scored.attribution["rows"].select(F.coalesce("key", F.lit("-")).alias("key"), "ds", total.alias("total")).toPandas()
    joined = predicted(scored).merge(sums, on=["key", "ds"])
    assert len(joined) == len(sums) > 2000
    assert np.allclose(joined.prediction, joined.total, rtol=1e-9)


def test_leaf_attributions_equal_all_coalitions():
    rng = np.random.default_rng(2)
    leaf = attribution.Leaf(
        2.5, np.array([3, 0, 2, 1]), np.array([-1.0, -np.inf, 0.0, -0.5]), np.array([0.5, 0.2, np.inf, np.inf]), np.array([0.4, 0.7, 0.2, 0.9])
    )
    x = rng.normal(size=(40, 4))
    got = attribution.leaf_attributions(leaf, x)
    for row, phi in zip(x, got):
        v = row[leaf.features]
        passes = (v > leaf.low) & (v <= leaf.high)
        worth = lambda group: leaf.value * np.prod([passes[j] if j in group else leaf.share[j] for j in range(4)])
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(
                factorial(s) * factorial(3 - s) / factorial(4) * (worth({*group, i}) - worth(set(group)))
                for s in range(4)
                for group in combinations(others, s)
            )
            assert phi[i] == pytest.approx(want)


def test_tables_equal_paths():
    """Looked-up contributions of leaves of all depths equal those worked out row by row, at the walls and for missing numbers too."""
    rng = np.random.default_rng(2)
    leaves = []
    for depth in [1, 2, 3, 6, 6, 8, 9, 10]:
        features = rng.choice(12, depth, replace=False)
        low, high = np.sort(rng.integers(0, 9, (2, depth)) / 2, axis=0)
        low, high = np.where(rng.random(depth) < 0.3, -np.inf, low), np.where(rng.random(depth) < 0.3, np.inf, high)
        leaves.append(attribution.Leaf(rng.normal(), features, low, high, rng.uniform(0.05, 0.95, depth)))
    x = rng.integers(-1, 10, (500, 12)) / 2
    x[0, :] = np.nan
    want = np.zeros(x.shape)
    for leaf in leaves:
        want[:, leaf.features] += attribution.leaf_attributions(leaf, x)
    tables = attribution.Tables(leaves, 12)
    assert len(tables.leaves) == 6 and len(tables.others) == 2
    assert np.allclose(tables.attributions(x), want)


def test_attribution_summaries(boosted):
    temporal = boosted.attribution["temporal"].toPandas()
    assert sorted(temporal["value"]) == list(range(7)) and temporal["shap_norm"].abs().max() == pytest.approx(1.0)
    assert temporal["count"].sum() == boosted.attribution["rows"].count()
    effect = boosted.attribution["exogenous"].first()
    assert effect["column"] == "x" and effect["features"] == ["x_lag_1", "x_actual"]
    assert effect["direction"] == ("positive" if effect["mean_shap"] > 0 else "negative" if effect["mean_shap"] < 0 else "neutral")


def test_dense_calendars(spark):
    df = spark.createDataFrame([("hour_of_day", 3, 0.0, 2)], "`group` string, value int, shap double, count long")
    groups = [g for g in attribution.GROUPS]
    full = attribution.normalise(attribution.dense(df, groups)).toPandas()
    assert full.groupby("group").size().to_dict() == {"hour_of_day": 24, "day_of_week": 7, "month": 12, "minute_of_day": 1440}
    # A group without any effect is divided by 1.
    assert (full["shap_norm"] == 0).all()
    assert full[full.group == "month"]["value"].min() == 1


# --- comparison ---------------------------------------------------------------------------------


def test_bounds_hold_their_share(spark):
    """Of many series with known noise, about the stated share of later values lies within the bounds, whatever the model."""
    rng, keyed = np.random.default_rng(17), {}
    for number in range(60):
        values = np.zeros(420)
        for t in range(1, 420):
            values[t] = 0.6 * values[t - 1] + rng.normal()
        keyed[f"s{number}"] = values + 50
    panel = Panel.of(spark.createDataFrame(data.panel_rows(keyed), data.SCHEMA).persist(), SPEC)
    ranges = FixedRanges([DateRange("2020-01-01", "2020-12-31")], [DateRange("2021-01-01", "2021-02-10")])
    scopes = {"fit_scope": "series"}
    shares = {}
    for model, fit, params in (
        ("ols", fit_ols, {"lags": [1], **scopes}),
        ("wide", fit_ols, {"lags": list(range(1, 15)), **scopes}),
        ("standard", fit_ols, {"lags": [1, 7], "standardize": True, **scopes}),
        ("arima", arima.fit_arima, {"p": 1, "d": 0, "q": 0}),
        ("arma", arima.fit_arima, {"p": 1, "d": 0, "q": 1}),
        ("lag", fit_lag, {}),
        ("gbt", fit_gbt, {"n_estimators": 3, "max_depth": 2, "lags": [1]}),
    ):
        forecast = fit(panel, ranges, ModelSpec(model, model, model, {**params, "interval": 0.9})).forecast
        inside = F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))
        shares[model] = forecast.agg(inside).first()[0]
        assert forecast.filter("not (lower < prediction and prediction < upper)").isEmpty()
    assert all(abs(share - 0.9) < 0.03 for share in shares.values()), shares


def test_bounds_of_decomposition(panel):
    model = ModelSpec("m", "PROPHET", "M", {"interval": 0.9, "yearly_seasonality": False})
    forecast = decomp.fit_decomp(panel, RANGES, model).forecast
    assert forecast.filter("not (lower < prediction and prediction < upper)").isEmpty()


def test_interval_out_of_range(panel):
    with pytest.raises(ValueError, match="between 0 and 1"):
        fit_lag(panel, RANGES, ModelSpec("m", "LAG", "M", {"interval": 95}))


def test_regression_variance_equals_numpy(panel, series):
    model = ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1, 7], "fit_scope": "series", "interval": 0.95})
    got = predicted(fit_ols(panel, RANGES, model))
    for key, values in series.items():
        x = np.column_stack([np.ones(724), values[6:730], values[:724]])
        beta, left = np.linalg.lstsq(x, values[7:731], rcond=None)[:2]
        cov = np.linalg.inv(x.T @ x) * left[0] / (724 - 3)
        part = got[(got.key == (key or "-")) & (got.range_id == 0)]
        rows = np.column_stack([np.ones(91), values[729:820], values[723:814]])
        sd = np.sqrt(left[0] / 721 + np.einsum("ij,jk,ik->i", rows, cov, rows))
        assert np.allclose(part.upper - part.prediction, 1.959963985 * sd, rtol=1e-6)


def test_alternation_leaves_settled_series(spark, panel):
    """A series that follows its model settles; the limit of rounds is reported for those that don't."""
    params = {"seasonality_mode": "multiplicative", "yearly_seasonality": False, "use_lag_regressors": False, "tolerance": 0.01, "rounds": 8}
    ended = decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", params)).fits.collect()
    # The series around 5 changes its sign, so that no trend can be multiplied: it does not settle.
    assert {row["key"]: (row["converged"], row["rounds"] < 8) for row in ended} == {"a": (True, True), "b": (True, True), None: (False, False)}
    ended = decomp.fit_decomp(panel, RANGES, ModelSpec("m", "PROPHET", "M", {**params, "rounds": 1, "tolerance": 0.0})).fits.collect()
    assert not any(row["converged"] for row in ended) and {row["rounds"] for row in ended} == {1}


def test_metrics_by_hand(spark):
    rows = [("a", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 6.0), ("flat", 3.0, 4.0), ("flat", 3.0, 2.0), ("none", 0.0, 1.0)]
    out = {r["g"]: r for r in metrics(spark.createDataFrame(rows, "g string, actual double, prediction double"), ("g",)).collect()}
    a = out["a"]
    assert a["rmse"] == pytest.approx(np.sqrt(2)) and a["mae"] == pytest.approx(4 / 3)
    assert a["mape"] == pytest.approx(0.5) and a["r2"] == pytest.approx(1 - 6 / 8)
    assert out["flat"]["r2"] == 0 and out["none"]["mape"] == 0


def test_top_importance_per_series(spark):
    rows = [("m", key, i, f"f{i}", float(i)) for key in "ab" for i in range(3)]
    frame = spark.createDataFrame(rows, "model_id string, key string, feature_pos int, feature string, importance double")
    assert sorted((r["key"], r["rank"], r["more"]) for r in top_importance(frame, top=2).collect()) == [(k, i, 1) for k in "ab" for i in (1, 2)]


def test_top_importance_ties_follow_feature_order(spark):
    rows = [("m", i, f"f{i}", 1.0 if i < 14 else 5.0) for i in range(15)]
    out = top_importance(spark.createDataFrame(rows, "model_id string, feature_pos int, feature string, importance double")).orderBy("rank").collect()
    assert [r["feature"] for r in out] == ["f14", *[f"f{i}" for i in range(11)]]
    assert {r["more"] for r in out} == {3} and out[1]["width"] == 0.2


def test_run_of_many_models(spark, series, panel, tmp_path):
    models = [
        ModelSpec("lag", "LAG", "Lag"),
        ModelSpec("far", "LAG", "Far", {"lag": 5000}),
        ModelSpec("ols", "LINEAR_REGRESSION", "Linear"),
        ModelSpec("bad", "LINEAR_REGRESSION", "Bad", {"lags": "x"}),
        ModelSpec("ar", "ARIMA", "Arima", {"q": 0}),
        ModelSpec("other", "NBEATS", "Other"),
    ]
    raw = panel.df.select("key", F.date_format("ds", "dd/MM/yyyy").alias("ds"), F.concat(F.lit("$"), F.round("y", 3).cast("string")).alias("y"))
    run = train_models(raw, SPEC, models, RANGES)
    rows = {(r["model_id"], r["scope"]): r for r in run.results.collect()}
    assert {k[0]: r["status"] for k, r in rows.items()} == {
        "lag": "ok", "far": "error", "ols": "ok", "bad": "error", "ar": "ok", "other": "unsupported"
    }
    assert rows["far", None]["message"] == "No training data available after applying lag 5000"
    assert rows["far", None]["rmse"] is None and rows["lag", "train"]["n"] == 3 * 730
    board = run.leaderboard().collect()
    assert {r["model_id"] for r in board} == {"lag", "ols", "ar"}
    assert [r["model_id"] for r in board if r["is_best"]] == [min(board, key=lambda r: r["rmse"])["model_id"]]
    table = run.forecast_table()
    assert table.columns == ["key", "ds", "actual", "Lag", "Linear", "Arima"] and table.count() == 3 * 91
    write_forecast_csv(table, str(tmp_path / "out"), "ds", ("key",))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 3 * 91 and back.first()["ds"].startswith("2021-12-31T00:00:00")
    assert {r["model_id"] for r in run.importance().select("model_id").distinct().collect()} == {"ols"}


def test_overlapping_training_ranges_count_twice(panel, series):
    twice = FixedRanges([DateRange("2020-01-01", "2021-12-31"), DateRange("2021-01-01", "2021-06-30")], RANGES._ranges["predict"])
    fit = fit_lag(panel, twice, ModelSpec("lag", "LAG", "Lag"))
    assert fit.train_scored.count() == 3 * (730 + 181)
    got = predicted(fit_ols(panel, twice, ModelSpec("m", "LINEAR_REGRESSION", "M", {"lags": [1]})))
    df = lags(frame(series), [1])
    train = pd.concat([in_train(df), df[df.ds.between("2021-01-01", "2021-06-30")]]).dropna()
    slope, intercept = np.polyfit(train.l1, train.y, 1)
    assert np.allclose(got.prediction, intercept + slope * in_predict(df).l1)


def test_repeated_dates_in_arima_training(panel):
    """Rows of overlapping ranges stand next to each other in date order."""
    twice = FixedRanges([DateRange("2020-01-01", "2021-12-31"), DateRange("2021-12-31", "2021-12-31")], RANGES._ranges["predict"])
    got = predicted(arima.fit_arima(panel, twice, ModelSpec("m", "ARIMA", "M", {"p": 1, "d": 1, "q": 0})))
    last = panel.df.filter("ds = '2021-12-31' and key = 'a'").first()["y"]
    # The last difference is 0, so the forecast is flat.
    assert np.allclose(got[(got.key == "a")].prediction, last)


def test_run_needs_no_keys(spark):
    df = data.month(spark)
    ranges = FixedRanges([DateRange("2023-01-01", "2023-01-24")], [DateRange("2023-01-24", "2023-01-30")])
    models = [ModelSpec("lag", "LAG", "Lag"), ModelSpec("ols", "LINEAR_REGRESSION", "Linear", {"lags": [1]}),
              ModelSpec("ar", "ARIMA", "Arima"), ModelSpec("p", "PROPHET", "P", {"lag_regressors": [1]})]
    run = run_models(Panel.of(df, SeriesSpec("date", "value")), models, ranges)
    assert {r["status"] for r in run.results.collect()} == {"ok"}
    lag = run.results.filter("model_id = 'lag' and scope = 'predict'").first()
    values = data.VALUES
    errors = np.array([values[i] - values[i - 1] for i in range(23, 30)])
    assert lag["rmse"] == pytest.approx(np.sqrt((errors**2).mean())) and lag["n"] == 7


@pytest.mark.parametrize(("fit", "params"), [(fit_ols, {}), (fit_ols, {"standardize": True, "interval": 0.9}), (fit_gbt, {"n_estimators": 2, "max_depth": 2})])
def test_names_with_dots_and_of_features(panel, fit, params):
    """A fit on a column with a dot in its name equals that on the plain name; a column called like a feature changes nothing."""

    def predictions(column: str, extra: bool):
        renamed = panel.df.withColumnRenamed("x", column)
        if extra:
            renamed = renamed.withColumn("target_lag_1", F.lit(0.0)).withColumn(f"{column}_lag_2", F.lit(0.0))
        config = FeatureConfig(target_lags=[1], exogenous=[Exogenous(column, lags=[2], use_actual=True)])
        got = fit(panel.on(renamed), RANGES, ModelSpec("m", "M", "M", {**params, "feature_config": config}))
        assert {row["feature"] for row in got.importance.collect()} == {"target_lag_1", f"{column}_lag_2", f"{column}_actual"}
        return predicted(got).prediction

    assert np.allclose(predictions("plain", False), predictions("with.dots", True))


def test_errors_of_a_model_and_others(panel, monkeypatch):
    """A matrix that can't be solved in a task is one model's failure; a missing name is nobody's and stops the run."""
    from panelcast import run

    def failing(kind: str):
        @F.pandas_udf("double")
        def fail(y: pd.Series) -> pd.Series:
            if kind == "matrix":
                raise np.linalg.LinAlgError("Singular matrix")
            return undefined_name  # noqa: F821

        return lambda ready, ranges, model: run.fit_lag(ready.on(ready.df.withColumn("y", fail("y"))), ranges, model)

    models = [ModelSpec("bad", "BAD", "Bad"), ModelSpec("lag", "LAG", "Lag")]
    monkeypatch.setitem(run.TRAINERS, "BAD", failing("matrix"))
    status = {(row["model_id"], row["status"]) for row in run.run_models(panel, models, RANGES).results.collect()}
    assert status == {("bad", "error"), ("lag", "ok")}
    monkeypatch.setitem(run.TRAINERS, "BAD", failing("name"))
    with pytest.raises(Exception, match="undefined_name"):
        run.run_models(panel, models, RANGES)
