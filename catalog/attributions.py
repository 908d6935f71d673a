"""Summaries of attributions, on a table of attributions made by arithmetic from the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import attribution
from panelcast.operators.attribution import by_column, by_value, dense, normalise, pair_sums, strong_values, used_groups

from .panels import DAILY, daily, round_all, table
from .registry import query

_DAILY_ATTR = f"""{DAILY}, attr AS (SELECT o_orderpriority, ds, y / 1000 - 400 AS dow_sin, n_orders * 3.5 AS dow_cos, spread / 500 AS month_sin,
    -top_price / 700 AS month_cos, top_price / 100 - 2000 AS n_orders_lag_1, -y / 2000 AS n_orders_actual, spread - 100 AS top_price_delta_1 FROM daily)"""
_DAILY_PAIRS = """pairs AS (SELECT o_orderpriority, ds, 'day_of_week' AS "group", CAST(isodow(ds) - 1 AS INT) AS value, dow_sin + dow_cos AS shap FROM attr
    UNION ALL SELECT o_orderpriority, ds, 'month', CAST(month(ds) AS INT), month_sin + month_cos FROM attr)"""
SOURCE = {"n_orders_lag_1": "n_orders", "n_orders_actual": "n_orders", "top_price_delta_1": "top_price"}


def _daily_attributions(spark: SparkSession, sf: str) -> DataFrame:
    y, n, top, spread = F.col("y"), F.col("n_orders"), F.col("top_price"), F.col("spread")
    return daily(spark, sf).select(
        "o_orderpriority",
        "ds",
        (y / 1000 - 400).alias("dow_sin"),
        (n * 3.5).alias("dow_cos"),
        (spread / 500).alias("month_sin"),
        (-top / 700).alias("month_cos"),
        (top / 100 - 2000).alias("n_orders_lag_1"),
        (-y / 2000).alias("n_orders_actual"),
        (spread - 100).alias("top_price_delta_1"),
    )


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, list[attribution.Group]]:
    rows = _daily_attributions(spark, sf)
    groups = used_groups(rows.columns)
    return pair_sums(rows, "ds", groups), groups


@query(f"WITH {_DAILY_ATTR}, {_DAILY_PAIRS} SELECT o_orderpriority, ds, \"group\", value, ROUND(shap, 6) + 0.0 AS shap FROM pairs")
def attr_pair_sum(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _ = _pairs(spark, sf)
    return round_all(pairs.select("o_orderpriority", "ds", "group", "value", "shap"), ["shap"])


_BY_VALUE = """byv AS (SELECT "group", value, AVG(shap) AS shap, COUNT(*) AS "count" FROM pairs GROUP BY 1, 2)"""


@query(f"WITH {_DAILY_ATTR}, {_DAILY_PAIRS}, {_BY_VALUE} SELECT \"group\", value, ROUND(shap, 6) + 0.0 AS shap, \"count\" FROM byv")
def attr_by_value(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(by_value(_pairs(spark, sf)[0]), ["shap"])


@query("""WITH domain AS (SELECT 'hour_of_day' AS "group", CAST(range AS INT) AS value FROM range(24)
    UNION ALL SELECT 'minute_of_day', CAST(range AS INT) FROM range(1440)),
  pairs AS (SELECT 'hour_of_day' AS "group", CAST(hour(ts) AS INT) AS value, value - 10 AS shap FROM events
    UNION ALL SELECT 'minute_of_day', CAST(hour(ts) * 60 + minute(ts) AS INT), 3 * value FROM events),
  byv AS (SELECT "group", value, AVG(shap) AS shap, COUNT(*) AS "count" FROM pairs GROUP BY 1, 2)
  SELECT "group", value, ROUND(COALESCE(shap, 0), 6) + 0.0 AS shap, COALESCE("count", 0) AS "count" FROM domain LEFT JOIN byv USING ("group", value)""")
def attr_dense(spark: SparkSession, sf: str) -> DataFrame:
    """All 24 hours and 1440 minutes, seen or not."""
    value = F.col("value")
    rows = table(spark, sf, "events").select(
        "ts",
        (value / 2 - 10).alias("hour_sin"),
        (value / 2).alias("hour_cos"),
        value.alias("minute_of_day_sin"),
        (2 * value).alias("minute_of_day_cos"),
    )
    groups = used_groups(rows.columns)
    return round_all(dense(by_value(pair_sums(rows, "ts", groups)), groups), ["shap"])


_NORMALISED = """norm AS (SELECT *, shap / CASE WHEN MAX(ABS(shap)) OVER (PARTITION BY "group") = 0 THEN 1
    ELSE MAX(ABS(shap)) OVER (PARTITION BY "group") END AS shap_norm FROM byv)"""


@query(f"""WITH {_DAILY_ATTR}, {_DAILY_PAIRS}, {_BY_VALUE}, {_NORMALISED}
  SELECT "group", value, "count", ROUND(shap, 6) + 0.0 AS shap, ROUND(shap_norm, 6) + 0.0 AS shap_norm FROM norm""")
def attr_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Every weekday and month is there, so the dense table has the same values."""
    pairs, groups = _pairs(spark, sf)
    return round_all(normalise(dense(by_value(pairs), groups)), ["shap", "shap_norm"])


@query(f"""WITH {_DAILY_ATTR}, m AS (
    SELECT 'n_orders' AS "column", (SUM(ABS(n_orders_lag_1)) + SUM(ABS(n_orders_actual))) / (2 * COUNT(*)) AS a,
           (SUM(n_orders_lag_1) + SUM(n_orders_actual)) / (2 * COUNT(*)) AS m, 'n_orders_lag_1,n_orders_actual' AS features FROM attr
    UNION ALL SELECT 'top_price', AVG(ABS(top_price_delta_1)), AVG(top_price_delta_1), 'top_price_delta_1' FROM attr)
  SELECT "column", ROUND(a, 4) AS mean_abs_shap, ROUND(m, 4) AS mean_shap,
         CASE WHEN m > 0 THEN 'positive' WHEN m < 0 THEN 'negative' ELSE 'neutral' END AS direction, features FROM m""")
def attr_exog(spark: SparkSession, sf: str) -> DataFrame:
    """The list of features is joined to one text, so that both sides compare plain values."""
    effects = by_column(_daily_attributions(spark, sf), SOURCE)
    effects = effects.withColumn("features", F.array_join("features", ","))
    return round_all(effects, ["mean_abs_shap", "mean_shap"], 4)


@query(f"""WITH {_DAILY_ATTR}, {_DAILY_PAIRS}, {_BY_VALUE}, {_NORMALISED}
  SELECT "group", COUNT(*) FILTER (shap_norm > 0.3) AS positive, COUNT(*) FILTER (shap_norm < -0.3) AS negative FROM norm GROUP BY 1""")
def attr_strong(spark: SparkSession, sf: str) -> DataFrame:
    pairs, groups = _pairs(spark, sf)
    return strong_values(normalise(dense(by_value(pairs), groups)))
