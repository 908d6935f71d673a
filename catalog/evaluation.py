"""Metrics, leaderboard, error series, export and importance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.base import FixedRanges
from panelcast.models.lag import fit_lag
from panelcast.operators import evaluate
from panelcast.plans.lineage import new_path
from panelcast.sources.files import forecast_table, read_csv, write_forecast_csv
from panelcast.spec import ModelSpec

from .panels import DAILY, DAILY_W, PREDICT, PREDICT_SQL, TRAIN, daily_panel, round_all, table
from .registry import query

METRIC_NAMES = list(evaluate.METRICS)


def metrics_sql(actual: str = "actual", prediction: str = "prediction", digits: int = 6) -> str:
    error = f"({actual} - {prediction})"
    return f"""ROUND(SQRT(AVG({error} * {error})), {digits}) AS rmse, ROUND(AVG(ABS{error}), {digits}) AS mae,
      ROUND(COALESCE(AVG(CASE WHEN {actual} <> 0 THEN ABS({error} / {actual}) END), 0), {digits}) AS mape,
      ROUND(CASE WHEN VAR_POP({actual}) > 0 THEN 1 - SUM({error} * {error}) / (VAR_POP({actual}) * COUNT(*)) ELSE 0 END, {digits}) + 0.0 AS r2,
      COUNT(*) AS n"""


@query(f"""WITH t AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS actual,
      CAST(o_custkey * 150 AS DOUBLE) AS prediction FROM orders)
  SELECT o_orderpriority, {metrics_sql()} FROM t GROUP BY 1""")
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Actuals of 0 take no part in MAPE."""
    scored = table(spark, sf, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("actual"),
        (F.col("o_custkey") * 150).cast("double").alias("prediction"),
    )
    return round_all(evaluate.metrics(scored, ("o_orderpriority",)), METRIC_NAMES)


@query("""WITH t AS (SELECT o_orderpriority, o_totalprice AS p FROM orders)
  SELECT o_orderpriority, ROUND(SQRT(AVG(p * p)), 6) AS rmse, ROUND(AVG(p), 6) AS mae, 0.0 AS mape, 0.0 AS r2, COUNT(*) AS n FROM t GROUP BY 1""")
def metrics_constant(spark: SparkSession, sf: str) -> DataFrame:
    """Actuals that are all 0: MAPE and R2 are 0."""
    scored = table(spark, sf, "orders").select("o_orderpriority", F.lit(0.0).alias("actual"), F.col("o_totalprice").alias("prediction"))
    return round_all(evaluate.metrics(scored, ("o_orderpriority",)), METRIC_NAMES)


_PRIORITY_RMSE = "SELECT o_orderpriority AS model_id, ROUND(SQRT(AVG((o_totalprice - o_custkey) * (o_totalprice - o_custkey))), 2) AS rmse FROM orders GROUP BY 1"


@query(f"""WITH m AS ({_PRIORITY_RMSE}), r AS (SELECT * FROM m WHERE model_id <> '5-LOW')
  SELECT model_id, rmse, CAST(RANK() OVER (ORDER BY rmse) AS INT) AS rank, RANK() OVER (ORDER BY rmse) = 1 AS is_best FROM r""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities stand for models, one of which failed."""
    error = F.col("o_totalprice") - F.col("o_custkey")
    results = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("model_id"))
        .agg(F.round(F.sqrt(F.avg(error * error)), 2).alias("rmse"))
        .withColumn("status", F.when(F.col("model_id") == "5-LOW", "error").otherwise("ok"))
    )
    return evaluate.leaderboard(results).select("model_id", "rmse", "rank", "is_best")


_LAGS = (1, 7, 30)


def _lag_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of three lags; the longest misses the first rows of its series."""
    panel, ranges = daily_panel(spark, sf), FixedRanges([TRAIN], [TRAIN, PREDICT])
    fits = [fit_lag(panel, ranges, ModelSpec(f"lag{k}", "LAG", f"Lag {k}", {"lag": k})) for k in _LAGS]
    return reduce(DataFrame.unionByName, [fit.forecast for fit in fits])


_LAGGED = "t AS (SELECT o_orderpriority, ds, y, " + ", ".join(f"LAG(y, {k}) OVER {DAILY_W} AS l{k}" for k in _LAGS) + " FROM daily)"
_IN_RANGES = "ds BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-08-01'"


@query(f"""WITH {DAILY}, {_LAGGED} SELECT o_orderpriority, ds, y AS actual, l1 AS "Lag 1", l7 AS "Lag 7", l30 AS "Lag 30"
  FROM t WHERE {_IN_RANGES} AND l1 IS NOT NULL""")
def forecast_export(spark: SparkSession, sf: str) -> DataFrame:
    """One row per date with a column per model; the day in both ranges comes once."""
    models = [(f"lag{k}", f"Lag {k}") for k in _LAGS]
    return forecast_table(_lag_forecasts(spark, sf), models, "ds", ("o_orderpriority",))


@query(f"""WITH {DAILY}, {_LAGGED} SELECT o_orderpriority, strftime(ds, '%Y-%m-%dT%H:%M:%S') AS ds, y AS actual, l1 AS "Lag 1", l7 AS "Lag 7", l30 AS "Lag 30"
  FROM t WHERE {_IN_RANGES} AND l1 IS NOT NULL""")
def forecast_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The export written as CSV files and read back."""
    models, path = [(f"lag{k}", f"Lag {k}") for k in _LAGS], new_path(spark, "forecasts")
    write_forecast_csv(forecast_table(_lag_forecasts(spark, sf), models, "ds", ("o_orderpriority",)), path, "ds", ("o_orderpriority",))
    numbers = ", ".join(f"`{name}` double" for name in ("actual", *[name for _, name in models]))
    return read_csv(spark, path, f"o_orderpriority string, ds string, {numbers}")


@query(f"""WITH {DAILY}, {_LAGGED}, f AS ({' UNION ALL '.join(f"SELECT 'lag{k}' AS model_id, o_orderpriority, ds, y, l{k} AS p FROM t" for k in _LAGS)}),
  r AS (SELECT *, 0 AS range_id FROM f WHERE ds BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31'
        UNION ALL SELECT *, 1 FROM f WHERE {PREDICT_SQL})
  SELECT model_id, range_id, o_orderpriority, ds, ROUND(p - y, 2) + 0.0 AS error FROM r WHERE p IS NOT NULL""")
def error_series(spark: SparkSession, sf: str) -> DataFrame:
    errors = evaluate.error_series(_lag_forecasts(spark, sf))
    return round_all(errors.select("model_id", "range_id", "o_orderpriority", "ds", "error"), ["error"], 2)


_IMPORTANCE = """imp AS (SELECT l_returnflag AS model_id, CAST(l_suppkey AS INT) AS feature_pos, 'supplier_' || l_suppkey AS feature,
    SUM(l_quantity) AS importance FROM lineitem GROUP BY 1, 2, 3)"""


@query(f"""WITH {_IMPORTANCE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY importance DESC, feature_pos) AS rank,
    importance / MAX(importance) OVER (PARTITION BY model_id) AS width, GREATEST(COUNT(*) OVER (PARTITION BY model_id) - 12, 0) AS more FROM imp)
  SELECT model_id, feature_pos, feature, importance, CAST(rank AS INT) AS rank, ROUND(width, 6) AS width, more FROM r WHERE rank <= 12""")
def top_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' quantities stand for importances, return flags for models."""
    feature = F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"))
    importance = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model_id"), F.col("l_suppkey").cast("int").alias("feature_pos"), feature.alias("feature"))
        .agg(F.sum("l_quantity").alias("importance"))
    )
    return round_all(evaluate.top_importance(importance), ["width"])
