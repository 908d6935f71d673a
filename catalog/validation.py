"""Models fitted before each of several dates and scored on what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.spec import ModelSpec
from panelcast.walk import folds, validation, walk_linear

from .evaluation import METRIC_NAMES, metrics_sql
from .panels import DAILY, DAILY_W, daily_panel, round_all
from .registry import query

#: Five cuts, 180 days apart.
CUTS = ["1998-01-01", "1998-06-30", "1998-12-27", "1999-06-25", "1999-12-22"]
_CUTS_SQL = "cuts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, TIMESTAMP '{cut}')" for i, cut in enumerate(CUTS)) + ") AS c(fold, cut))"


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS l1 FROM daily), {_CUTS_SQL},
  fit AS (SELECT fold, cut, regr_slope(y, l1) AS b, regr_intercept(y, l1) AS a FROM t, cuts WHERE ds < cut AND l1 IS NOT NULL GROUP BY 1, 2),
  scored AS (SELECT fold, cut, y AS actual, a + b * l1 AS prediction, l1 FROM t, fit WHERE ds >= cut AND ds < cut + INTERVAL 180 DAY AND l1 IS NOT NULL),
  scores AS (SELECT 'ols' AS model_id, fold, cut, actual, prediction FROM scored UNION ALL SELECT 'lag', fold, cut, actual, l1 FROM scored)
  SELECT model_id, CAST(fold AS INT) AS fold, cut, {metrics_sql(digits=4)} FROM scores GROUP BY 1, 2, 3""")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of five folds whose training rows grow: a regression, from one pass, and the baseline."""
    models = [ModelSpec("ols", "LINEAR_REGRESSION", "Linear", {"lags": [1]}), ModelSpec("lag", "LAG", "Lag")]
    table = validation(daily_panel(spark, sf), models, folds(CUTS[0], len(CUTS), 180))
    return round_all(table, METRIC_NAMES, 4)


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS l1 FROM daily), {_CUTS_SQL},
  fit AS (SELECT fold, cut, o_orderpriority, regr_slope(y, l1) AS b, regr_intercept(y, l1) AS a FROM t, cuts
    WHERE ds < cut AND ds >= cut - INTERVAL 365 DAY AND l1 IS NOT NULL GROUP BY 1, 2, 3)
  SELECT CAST(fold AS INT) AS fold, o_orderpriority, ds, ROUND(a + b * l1, 4) AS prediction, y AS actual FROM t JOIN fit USING (o_orderpriority)
  WHERE ds >= cut AND ds < cut + INTERVAL 30 DAY AND l1 IS NOT NULL""")
def walk_forward_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of five folds, each series fitted on the year before the cut, of which the folds share parts."""
    model = ModelSpec("ols", "LINEAR_REGRESSION", "Linear", {"lags": [1], "fit_scope": "series"})
    rows = walk_linear(daily_panel(spark, sf), model, folds(CUTS[0], len(CUTS), 180, 30, 365))
    out = rows.select(F.col("range_id").alias("fold"), "o_orderpriority", "ds", "prediction", "actual")
    return round_all(out, ["prediction"], 4)
