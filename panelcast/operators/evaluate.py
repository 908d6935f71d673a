"""Metrics of forecasts, leaderboards, error series and importance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "mape", "r2")


def metric_columns(actual: Column, prediction: Column) -> list[Column]:
    """RMSE, MAE, MAPE and R2 as aggregates of one pass.

    MAPE is a fraction over rows with an actual other than 0, and 0 if there are none. R2 is 0 when the
    actuals do not vary. The total sum of squares comes from the variance, whose partial results merge
    without losing digits.
    """
    error = actual - prediction
    rows, total = F.count(error), F.var_pop(actual) * F.count(error)
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(rows > 0, F.coalesce(F.avg(F.when(actual != 0, F.abs(error / actual))), F.lit(0.0))).alias("mape"),
        F.when(total > 0, 1 - F.sum(error * error) / total).when(rows > 0, F.lit(0.0)).alias("r2"),
    ]


def metrics(scored: DataFrame, by: tuple[str, ...] = (), actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """One row of metrics per group of ``by``."""
    return scored.groupBy(*by).agg(*metric_columns(F.col(actual), F.col(prediction)), F.count(F.lit(1)).alias("n"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Models by RMSE with the best flagged; failed models carry no metrics and take no part.

    One row per model, so the unpartitioned window sees a handful of rows.
    """
    ranked = results.filter((F.col("status") == "ok") & F.col("rmse").isNotNull())
    place = F.rank().over(Window.orderBy("rmse"))
    return ranked.withColumn("rank", place).withColumn("is_best", F.col("rank") == 1)


def error_series(forecasts: DataFrame) -> DataFrame:
    """Prediction minus actual per model and date."""
    return forecasts.withColumn("error", F.col("prediction") - F.col("actual"))


def top_importance(importance: DataFrame, by: tuple[str, ...] | None = None, top: int = 12) -> DataFrame:
    """The largest importances per model, their width against the model's largest, and how many are left out.

    ``by`` tells fits apart; unless given it is the model and, for fits per series, the series' keys. A fit has as
    many rows as features, so its window stays small.
    """
    if by is None:
        by = tuple(name for name in importance.columns if name not in ("feature_pos", "feature", "importance"))
    model = Window.partitionBy(*by)
    order = model.orderBy(F.desc("importance"), "feature_pos")
    listed = importance.select(
        "*",
        F.row_number().over(order).alias("rank"),
        (F.col("importance") / F.max("importance").over(model)).alias("width"),
        F.greatest(F.count(F.lit(1)).over(model) - top, F.lit(0)).alias("more"),
    )
    return listed.filter(F.col("rank") <= top)
