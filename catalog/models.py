"""Models fitted and scored on whole panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.arima import fit_arima
from panelcast.models.base import FixedRanges, Fitted
from panelcast.models.decomp import fit_decomp
from panelcast.models.gbt import fit_gbt
from panelcast.models.lag import fit_lag
from panelcast.models.ols import fit_ols
from panelcast.operators.evaluate import metrics
from panelcast.run import run_models
from panelcast.spec import Exogenous, FeatureConfig, ModelSpec, Temporal

from .evaluation import METRIC_NAMES, metrics_sql
from .panels import DAILY, DAILY_W, PREDICT, PREDICT_SQL, TRAIN, TRAIN_SQL, daily_panel, round_all
from .registry import query

RANGES = FixedRanges([TRAIN], [PREDICT])


def _lag_scored(k: int = 1) -> str:
    return f"""t AS (SELECT o_orderpriority, ds, y AS actual, LAG(y, {k}) OVER {DAILY_W} AS prediction FROM daily),
  scored AS (SELECT *, 'train' AS scope FROM t WHERE {TRAIN_SQL} AND prediction IS NOT NULL
             UNION ALL SELECT *, 'predict' FROM t WHERE {PREDICT_SQL} AND prediction IS NOT NULL)"""


@query(f"WITH {DAILY}, {_lag_scored()} SELECT o_orderpriority, scope, {metrics_sql()} FROM scored GROUP BY ALL")
def slice_lag_daily(spark: SparkSession, sf: str) -> DataFrame:
    """From orders to metrics per series and scope of the baseline model."""
    fit = fit_lag(daily_panel(spark, sf), RANGES, ModelSpec("lag", "LAG", "Lag"))
    scopes = {"train": fit.train_scored, "predict": fit.forecast}
    scored = reduce(DataFrame.unionByName, [df.withColumn("scope", F.lit(s)) for s, df in scopes.items()])
    return round_all(metrics(scored, ("o_orderpriority", "scope")), METRIC_NAMES)


@query(f"""WITH {DAILY}, {_lag_scored(7)} SELECT 'lag7' AS model_id, 'Lag 7' AS model_name, 0 AS range_id, o_orderpriority, ds, prediction, actual
  FROM scored WHERE scope = 'predict'""")
def lag_model(spark: SparkSession, sf: str) -> DataFrame:
    return fit_lag(daily_panel(spark, sf), RANGES, ModelSpec("lag7", "LAG", "Lag 7", {"lag": 7})).forecast


# --- linear regression --------------------------------------------------------------------------


def _two_feature_sql(x1: str, x2: str, y: str, source: str) -> str:
    """Least squares on two features in closed form."""
    return f"""sums AS (SELECT COVAR_POP({x1}, {x1}) AS c11, COVAR_POP({x2}, {x2}) AS c22, COVAR_POP({x1}, {x2}) AS c12,
      COVAR_POP({x1}, {y}) AS c1y, COVAR_POP({x2}, {y}) AS c2y, AVG({x1}) AS m1, AVG({x2}) AS m2, AVG({y}) AS my FROM {source}),
  coefs AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM sums),
  fit AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM coefs)"""


_LAGS_1_7 = f"""t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS l1, LAG(y, 7) OVER {DAILY_W} AS l7 FROM daily),
  train AS (SELECT *, y - l1 AS r FROM t WHERE {TRAIN_SQL} AND l1 IS NOT NULL AND l7 IS NOT NULL)"""
_FORECAST = f"FROM t, fit WHERE {PREDICT_SQL} AND l1 IS NOT NULL AND l7 IS NOT NULL"


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l1', 'l7', 'y', 'train')}
  SELECT o_orderpriority, ds, ROUND(b0 + b1 * l1 + b2 * l7, 4) AS prediction, y AS actual {_FORECAST}""")
def ols_model(spark: SparkSession, sf: str) -> DataFrame:
    """One fit for all series on lags 1 and 7."""
    fit = fit_ols(daily_panel(spark, sf), RANGES, ModelSpec("ols", "LINEAR_REGRESSION", "Linear"))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS l1 FROM daily),
  fit AS (SELECT o_orderpriority, regr_slope(y, l1) AS b, regr_intercept(y, l1) AS a FROM t WHERE {TRAIN_SQL} AND l1 IS NOT NULL GROUP BY 1)
  SELECT o_orderpriority, ds, ROUND(a + b * l1, 4) AS prediction, y AS actual FROM t JOIN fit USING (o_orderpriority)
  WHERE {PREDICT_SQL} AND l1 IS NOT NULL""")
def ols_per_series(spark: SparkSession, sf: str) -> DataFrame:
    params = {"lags": "1", "fit_scope": "series"}
    fit = fit_ols(daily_panel(spark, sf), RANGES, ModelSpec("ols", "LINEAR_REGRESSION", "Linear", params))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l7', 'l1', 'r', 'train')}
  SELECT o_orderpriority, ds, ROUND(b0 + b1 * l7 + b2 * l1 + l1, 4) AS prediction, y AS actual {_FORECAST}""")
def ols_residual(spark: SparkSession, sf: str) -> DataFrame:
    """The residual lag joins the features, and comes back on the prediction; features are standardised."""
    params = {"lags": [7], "target_mode": "residual", "residual_lag": 1, "standardize": True}
    fit = fit_ols(daily_panel(spark, sf), RANGES, ModelSpec("ols", "LINEAR_REGRESSION", "Linear", params))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l1', 'l7', 'y', 'train')},
  dev AS (SELECT STDDEV_POP(l1) AS s1, STDDEV_POP(l7) AS s7 FROM train)
  SELECT 'target_lag_1' AS feature, 0 AS feature_pos, ROUND(ABS(b1 * s1), 4) AS importance FROM fit, dev
  UNION ALL SELECT 'target_lag_7', 1, ROUND(ABS(b2 * s7), 4) FROM fit, dev""")
def ols_importance(spark: SparkSession, sf: str) -> DataFrame:
    params = {"standardize": True}
    fit = fit_ols(daily_panel(spark, sf), RANGES, ModelSpec("ols", "LINEAR_REGRESSION", "Linear", params))
    return round_all(fit.importance.drop("model_id"), ["importance"], 4)


@query(f"""WITH {DAILY}, fit AS (SELECT ABS(regr_slope(y, n_orders)) AS b FROM daily WHERE {TRAIN_SQL})
  SELECT 0 AS constants, 0 AS feature_pos, ROUND(b / 5, 4) AS importance FROM fit UNION ALL SELECT 0, 1, ROUND(b * 2 / 5, 4) FROM fit
  UNION ALL SELECT 12, 0, ROUND(b / 5, 4) FROM fit UNION ALL SELECT 12, 1, ROUND(b * 2 / 5, 4) FROM fit""")
def ols_wide_collinear(spark: SparkSession, sf: str) -> DataFrame:
    """A feature and its double share the slope as the least norm has it, whether or not constants join them."""
    panel = daily_panel(spark, sf)
    names = [f"constant_{i}" for i in range(12)]
    rows = panel.df.withColumns({"twin": 2 * F.col("n_orders"), **{name: F.lit(1.0) for name in names}})

    def importance(constants: list[str]) -> DataFrame:
        exogenous = [Exogenous(name, use_actual=True) for name in ["n_orders", "twin", *constants]]
        params = {"feature_config": FeatureConfig(target_lags=[], exogenous=exogenous)}
        fit = fit_ols(panel.on(rows), RANGES, ModelSpec("ols", "LINEAR_REGRESSION", "Linear", params))
        few = fit.importance.filter(F.col("feature_pos") < 2)
        return few.select(F.lit(len(constants)).alias("constants"), "feature_pos", "importance")

    return round_all(importance([]).unionByName(importance(names)), ["importance"], 4)


# --- ARIMA, decomposition, boosted trees --------------------------------------------------------


@query(f"""WITH {DAILY}, d AS (SELECT *, y - LAG(y) OVER {DAILY_W} AS w FROM daily WHERE {TRAIN_SQL}),
  e AS (SELECT *, LAG(w) OVER {DAILY_W} AS w1, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY ds DESC) AS back FROM d),
  fit AS (SELECT o_orderpriority, SUM(w * w1) / SUM(w1 * w1) AS phi FROM e WHERE w1 IS NOT NULL GROUP BY 1),
  state AS (SELECT o_orderpriority, y AS level, w FROM e WHERE back = 1),
  p AS (SELECT o_orderpriority, ds, y, ROW_NUMBER() OVER {DAILY_W} AS h FROM daily WHERE {PREDICT_SQL})
  SELECT o_orderpriority, ds, ROUND(level + w * phi * (1 - POW(phi, h)) / (1 - phi), 4) AS prediction, y AS actual
  FROM p JOIN fit USING (o_orderpriority) JOIN state USING (o_orderpriority)""")
def arima_ar(spark: SparkSession, sf: str) -> DataFrame:
    """ARIMA(1, 1, 0), whose forecast has a closed form."""
    fit = fit_arima(daily_panel(spark, sf), RANGES, ModelSpec("ar", "ARIMA", "AR", {"p": 1, "d": 1, "q": 0}))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query(f"""WITH {DAILY}, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY ds DESC) AS back FROM daily WHERE {TRAIN_SQL}),
  lasts AS (SELECT o_orderpriority, back, y FROM t WHERE back <= 8),
  p AS (SELECT o_orderpriority, ds, y, ROW_NUMBER() OVER {DAILY_W} AS h FROM daily WHERE {PREDICT_SQL}),
  k AS (SELECT *, (h + 6) // 7 AS seasons, 1 - (h - 7 * ((h + 6) // 7)) AS back FROM p)
  SELECT k.o_orderpriority, ds, ROUND(l.y + seasons * (a.y - b.y), 4) AS prediction, k.y AS actual FROM k
  JOIN lasts l ON l.o_orderpriority = k.o_orderpriority AND l.back = k.back
  JOIN lasts a ON a.o_orderpriority = k.o_orderpriority AND a.back = 1 JOIN lasts b ON b.o_orderpriority = k.o_orderpriority AND b.back = 8""")
def arima_seasonal_walk(spark: SparkSession, sf: str) -> DataFrame:
    """ARIMA(0, 1, 0)(0, 1, 0, 7): the last week again, moved each week by the last step over a week."""
    params = {"p": 0, "d": 1, "q": 0, "seasonal_order": (0, 1, 0, 7)}
    fit = fit_arima(daily_panel(spark, sf), RANGES, ModelSpec("walk", "ARIMA", "Seasonal walk", params))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query(f"""WITH {DAILY}, m AS (SELECT o_orderpriority, AVG(y) AS centre FROM daily WHERE {TRAIN_SQL} GROUP BY 1),
  t AS (SELECT o_orderpriority, ds, y - centre AS w, LAG(y - centre, 7) OVER {DAILY_W} AS w7, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY ds DESC) AS back
    FROM daily JOIN m USING (o_orderpriority) WHERE {TRAIN_SQL}),
  fit AS (SELECT o_orderpriority, regr_slope(w, w7) AS phi, regr_intercept(w, w7) AS c FROM t WHERE w7 IS NOT NULL GROUP BY 1),
  p AS (SELECT o_orderpriority, ds, y, ROW_NUMBER() OVER {DAILY_W} AS h FROM daily WHERE {PREDICT_SQL}),
  k AS (SELECT *, (h + 6) // 7 AS seasons, 1 - (h - 7 * ((h + 6) // 7)) AS back FROM p)
  SELECT o_orderpriority, k.ds, ROUND(centre + POW(phi, seasons) * t.w + c * (1 - POW(phi, seasons)) / (1 - phi), 4) AS prediction, y AS actual
  FROM k JOIN t USING (o_orderpriority, back) JOIN fit USING (o_orderpriority) JOIN m USING (o_orderpriority)""")
def arima_seasonal_ar(spark: SparkSession, sf: str) -> DataFrame:
    """ARIMA(0, 0, 0)(1, 0, 0, 7): each weekday decays to the mean by itself."""
    params = {"p": 0, "d": 0, "q": 0, "seasonal_order": (1, 0, 0, 7)}
    fit = fit_arima(daily_panel(spark, sf), RANGES, ModelSpec("season", "ARIMA", "Seasonal AR", params))
    return round_all(fit.forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query()
def arima_model(spark: SparkSession, sf: str) -> DataFrame:
    return fit_arima(daily_panel(spark, sf), RANGES, ModelSpec("arima", "ARIMA", "ARIMA")).forecast


@query()
def decomp_model(spark: SparkSession, sf: str) -> DataFrame:
    return fit_decomp(daily_panel(spark, sf), RANGES, ModelSpec("decomp", "PROPHET", "Decomposition")).forecast


@query()
def decomp_importance(spark: SparkSession, sf: str) -> DataFrame:
    return fit_decomp(daily_panel(spark, sf), RANGES, ModelSpec("decomp", "PROPHET", "Decomposition")).importance


GBT = ModelSpec(
    "gbt",
    "XGBOOST",
    "Boosted trees",
    {
        "feature_config": FeatureConfig(
            target_lags=[1, 7],
            temporal=Temporal(month=True, day_of_week=True),
            exogenous=[Exogenous("n_orders", lags=[1], use_actual=True)],
        ),
    },
)


@query()
def gbt_model(spark: SparkSession, sf: str) -> DataFrame:
    return fit_gbt(daily_panel(spark, sf), RANGES, GBT).forecast


@query()
def gbt_importance(spark: SparkSession, sf: str) -> DataFrame:
    return fit_gbt(daily_panel(spark, sf), RANGES, GBT).importance


@query()
def attribution_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of the boosted trees for every training row."""
    return fit_gbt(daily_panel(spark, sf), RANGES, GBT).attribution["rows"]


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 7) OVER {DAILY_W} AS l7, LAG(n_orders, 1) OVER {DAILY_W} AS n1 FROM daily)
  SELECT o_orderpriority, COUNT(*) AS n, CAST(0 AS BIGINT) AS n_apart FROM t WHERE {TRAIN_SQL} AND l7 IS NOT NULL AND n1 IS NOT NULL GROUP BY 1""")
def attribution_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows per series, and how many of them have a base and attributions that don't add up to the prediction of 100 trees of depth 6."""
    fit = fit_gbt(daily_panel(spark, sf), FixedRanges([TRAIN], [TRAIN]), GBT)
    rows, features = fit.attribution["rows"], [row["feature"] for row in fit.importance.collect()]
    total = F.col("base")
    for name in features:
        total = total + F.col(name)
    both = rows.select("o_orderpriority", "ds", total.alias("total")).join(fit.forecast, ["o_orderpriority", "ds"])
    apart = F.abs(F.col("total") - F.col("prediction")) > 1e-6 * F.greatest(F.abs("prediction"), F.lit(1.0))
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(apart).alias("n_apart"))


_BUSY = f"""t AS (SELECT *, CASE WHEN n_orders > 1 THEN 1 ELSE 0 END AS busy FROM daily), train AS (SELECT * FROM t WHERE {TRAIN_SQL}),
  fit AS (SELECT busy, AVG(y) AS prediction FROM train GROUP BY 1)"""


def _stump(spark: SparkSession, sf: str) -> Fitted:
    """One tree of one split, on whether a day has more than one order: the means of two groups."""
    panel = daily_panel(spark, sf)
    busy = panel.df.withColumn("busy", (F.col("n_orders") > 1).cast("int"))
    features = FeatureConfig(target_lags=[], exogenous=[Exogenous("busy", use_actual=True)])
    params = {"n_estimators": 1, "max_depth": 1, "feature_config": features}
    return fit_gbt(panel.on(busy), RANGES, ModelSpec("stump", "XGBOOST", "Stump", params))


@query(f"""WITH {DAILY}, {_BUSY} SELECT o_orderpriority, ds, ROUND(prediction, 4) AS prediction, y AS actual FROM t JOIN fit USING (busy) WHERE {PREDICT_SQL}""")
def gbt_stump(spark: SparkSession, sf: str) -> DataFrame:
    forecast = _stump(spark, sf).forecast
    return round_all(forecast.select("o_orderpriority", "ds", "prediction", "actual"), ["prediction"], 4)


@query("SELECT 'stump' AS model_id, 0 AS feature_pos, 'busy_actual' AS feature, CAST(1 AS DOUBLE) AS importance")
def gbt_stump_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _stump(spark, sf).importance


@query(f"""WITH {DAILY}, {_BUSY}, base AS (SELECT AVG(y) AS base FROM train)
  SELECT o_orderpriority, ds, ROUND(prediction - base, 4) AS busy_actual, ROUND(base, 4) AS base FROM train JOIN fit USING (busy), base""")
def gbt_stump_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The only feature accounts for all that sets a row apart from the mean."""
    return round_all(_stump(spark, sf).attribution["rows"], ["busy_actual", "base"], 4)


# --- many models --------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l1', 'l7', 'y', 'train')},
  scored AS (SELECT 'lag1' AS model_id, 'predict' AS scope, y AS actual, l1 AS prediction FROM t WHERE {PREDICT_SQL} AND l1 IS NOT NULL
    UNION ALL SELECT 'lag1', 'train', y, l1 FROM t WHERE {TRAIN_SQL} AND l1 IS NOT NULL
    UNION ALL SELECT 'ols', 'predict', y, b0 + b1 * l1 + b2 * l7 {_FORECAST})
  SELECT model_id, scope, 'ok' AS status, {metrics_sql(digits=4).replace("COUNT(*) AS n", "CAST(COUNT(*) AS DOUBLE) AS n")} FROM scored GROUP BY ALL
  UNION ALL SELECT 'far', NULL, 'error', NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'other', NULL, 'unsupported', NULL, NULL, NULL, NULL, NULL""")
def run_many(spark: SparkSession, sf: str) -> DataFrame:
    """Two models that work, one whose lag is too long and one of an unknown type."""
    models = [
        ModelSpec("lag1", "LAG", "Lag 1"),
        ModelSpec("ols", "LINEAR_REGRESSION", "Linear"),
        ModelSpec("far", "LAG", "Lag too far", {"lag": 1_000_000}),
        ModelSpec("other", "NBEATS", "Other"),
    ]
    results = run_models(daily_panel(spark, sf), models, RANGES).results
    return round_all(results.select("model_id", "scope", "status", *METRIC_NAMES, F.col("n").cast("double").alias("n")), METRIC_NAMES, 4)


_AR = f"""ard AS (SELECT *, y - LAG(y) OVER {DAILY_W} AS w FROM daily WHERE {TRAIN_SQL}),
  are AS (SELECT *, LAG(w) OVER {DAILY_W} AS w1, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY ds DESC) AS back FROM ard),
  arf AS (SELECT o_orderpriority, SUM(w * w1) / SUM(w1 * w1) AS phi FROM are WHERE w1 IS NOT NULL GROUP BY 1),
  ars AS (SELECT o_orderpriority, y AS level, w FROM are WHERE back = 1),
  arp AS (SELECT o_orderpriority, ds, y, ROW_NUMBER() OVER {DAILY_W} AS h FROM daily WHERE {PREDICT_SQL})"""


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l1', 'l7', 'y', 'train')}, {_AR},
  busy AS (SELECT n_orders > 1 AS busy, AVG(y) AS prediction FROM daily WHERE {TRAIN_SQL} GROUP BY 1),
  scored AS (SELECT 'lag' AS model_id, 'predict' AS scope, o_orderpriority, y AS actual, l1 AS prediction FROM t WHERE {PREDICT_SQL} AND l1 IS NOT NULL
    UNION ALL SELECT 'lag', 'train', o_orderpriority, y, l1 FROM t WHERE {TRAIN_SQL} AND l1 IS NOT NULL
    UNION ALL SELECT 'ols', 'predict', o_orderpriority, y, b0 + b1 * l1 + b2 * l7 {_FORECAST}
    UNION ALL SELECT 'arima', 'predict', o_orderpriority, y, level + w * phi * (1 - POW(phi, h)) / (1 - phi) FROM arp JOIN arf USING (o_orderpriority) JOIN ars USING (o_orderpriority)
    UNION ALL SELECT 'trees', 'predict', o_orderpriority, y, prediction FROM daily JOIN busy ON busy.busy = (n_orders > 1) WHERE {PREDICT_SQL}
    UNION ALL SELECT 'decomp', 'predict', o_orderpriority, y, NULL FROM t WHERE {PREDICT_SQL} AND l7 IS NOT NULL)
  SELECT model_id, scope, 'ok' AS status, ROUND(SQRT(AVG((actual - prediction) * (actual - prediction))), 3) AS rmse, CAST(COUNT(*) AS DOUBLE) AS n,
    CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) AS series_scored, CAST(0 AS DOUBLE) AS series_skipped FROM scored GROUP BY 1, 2
  UNION ALL SELECT 'far', NULL, 'error', NULL, NULL, NULL, NULL UNION ALL SELECT 'other', NULL, 'unsupported', NULL, NULL, NULL, NULL""")
def run_all(spark: SparkSession, sf: str) -> DataFrame:
    """All five types in one run, and two that fail. The decomposition's errors, which have no closed form, are left out."""
    busy = FeatureConfig(target_lags=[], exogenous=[Exogenous("busy", use_actual=True)])
    models = [
        ModelSpec("lag", "LAG", "Lag"),
        ModelSpec("ols", "LINEAR_REGRESSION", "Linear"),
        ModelSpec("arima", "ARIMA", "ARIMA", {"p": 1, "d": 1, "q": 0}),
        ModelSpec("trees", "XGBOOST", "Trees", {"n_estimators": 1, "max_depth": 1, "feature_config": busy}),
        ModelSpec("decomp", "PROPHET", "Decomposition"),
        ModelSpec("far", "LAG", "Lag too far", {"lag": 1_000_000}),
        ModelSpec("other", "NBEATS", "Other"),
    ]
    panel = daily_panel(spark, sf)
    run = run_models(panel.on(panel.df.withColumn("busy", (F.col("n_orders") > 1).cast("int"))), models, RANGES)
    known = F.when(F.col("model_id") != "decomp", F.col("rmse")).alias("rmse")
    counts = [F.col(name).cast("double").alias(name) for name in ("n", "series_scored", "series_skipped")]
    return round_all(run.results.select("model_id", "scope", "status", known, *counts), ["rmse"], 3)


@query(f"""WITH {DAILY}, t AS (SELECT *, EXTRACT(day FROM ds) = 1 AS first_day FROM daily WHERE {TRAIN_SQL})
  SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(y), 2) AS mean_actual, TRUE AS holds FROM t WHERE first_day GROUP BY 1""")
def decomp_holidays(spark: SparkSession, sf: str) -> DataFrame:
    """First days of months as a holiday: its effect is what makes their mean forecast the mean of their group, to the prior's pull."""
    panel = daily_panel(spark, sf)
    calendar = panel.df.filter(F.dayofmonth("ds") == 1).select(F.lit("first").alias("holiday"), F.col("ds").cast("date").alias("date")).distinct()
    params = {"use_lag_regressors": False, "holidays": calendar}
    rows = fit_decomp(panel, FixedRanges([TRAIN], [TRAIN]), ModelSpec("first", "PROPHET", "Holidays", params)).forecast
    near = F.abs(F.avg("prediction") - F.avg("actual")) <= 0.001 * F.abs(F.avg("actual"))
    days = rows.filter(F.dayofmonth("ds") == 1).groupBy("o_orderpriority")
    return days.agg(F.count("*").alias("n"), F.round(F.avg("actual"), 2).alias("mean_actual"), near.alias("holds"))


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds, ROUND(2.5 * date_diff('day', DATE '1995-01-01', CAST(ds AS DATE)) + 40, 1) AS prediction
  FROM daily WHERE {PREDICT_SQL}""")
def decomp_line(spark: SparkSession, sf: str) -> DataFrame:
    """A straight line, without seasons and lags, goes on as it is."""
    panel = daily_panel(spark, sf)
    line = panel.df.withColumn("y", 2.5 * F.datediff("ds", F.lit("1995-01-01").cast("date")) + 40)
    params = {"yearly_seasonality": False, "weekly_seasonality": False, "use_lag_regressors": False}
    forecast = fit_decomp(panel.on(line), RANGES, ModelSpec("line", "PROPHET", "Line", params)).forecast
    return round_all(forecast.select("o_orderpriority", "ds", "prediction"), ["prediction"], 1)


@query(f"""WITH {DAILY}, {_LAGS_1_7}, {_two_feature_sql('l1', 'l7', 'y', 'train')} SELECT model_id, o_orderpriority, {metrics_sql(digits=4)} FROM (
    SELECT 'lag' AS model_id, o_orderpriority, y AS actual, l1 AS prediction FROM t WHERE {PREDICT_SQL} AND l1 IS NOT NULL
    UNION ALL SELECT 'ols', o_orderpriority, y, b0 + b1 * l1 + b2 * l7 {_FORECAST}) GROUP BY 1, 2""")
def run_by_series(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each series under two models of one run."""
    models = [ModelSpec("lag", "LAG", "Lag"), ModelSpec("ols", "LINEAR_REGRESSION", "Linear")]
    return round_all(run_models(daily_panel(spark, sf), models, RANGES).by_series(), METRIC_NAMES, 4)
