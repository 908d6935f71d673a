"""Panels made from the supplied tables, and the same panels in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.dates import hour_start
from panelcast.plans.ordered import Panel
from panelcast.spec import DateRange, SeriesSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- orders per priority and day ----------------------------------------------------------------

DAILY_SPEC = SeriesSpec("ds", "y", ("o_orderpriority",))
TRAIN, PREDICT = DateRange("1995-01-01", "1999-12-31"), DateRange("1999-12-31", "2001-08-01")

DAILY = """daily AS (
  SELECT o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ds,
         ROUND(SUM(o_totalprice), 2) AS y, COUNT(*) AS n_orders,
         MAX(o_totalprice) AS top_price, MAX(o_totalprice) - MIN(o_totalprice) AS spread
  FROM orders GROUP BY 1, 2)"""
DAILY_W = "(PARTITION BY o_orderpriority ORDER BY ds)"
TRAIN_SQL = "ds BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31'"
PREDICT_SQL = "ds BETWEEN TIMESTAMP '1999-12-31' AND TIMESTAMP '2001-08-01'"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", day.alias("ds"))
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("y"),
            F.count(F.lit(1)).alias("n_orders"),
            F.max("o_totalprice").alias("top_price"),
            (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"),
        )
    )


def daily_panel(spark: SparkSession, sf: str) -> Panel:
    return Panel.of(daily(spark, sf), DAILY_SPEC)


# --- events per type and hour -------------------------------------------------------------------

HOURLY_SPEC = SeriesSpec("ds", "y", ("event_type",))
HOURLY = """hourly AS (
  SELECT event_type, DATE_TRUNC('hour', ts) AS ds, ROUND(SUM(value), 2) AS y, COUNT(*) AS n_events
  FROM events GROUP BY 1, 2)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("event_type", hour_start(F.col("ts")).alias("ds"))
        .agg(F.round(F.sum("value"), 2).alias("y"), F.count(F.lit(1)).alias("n_events"))
    )


def hourly_panel(spark: SparkSession, sf: str) -> Panel:
    return Panel.of(hourly(spark, sf), HOURLY_SPEC)


# --- shipments per return flag and day ----------------------------------------------------------

SHIP_SPEC = SeriesSpec("ds", "y", ("l_returnflag",))
SHIP = """ship AS (
  SELECT l_returnflag, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ds, SUM(l_quantity) AS y
  FROM lineitem GROUP BY 1, 2)"""


def ship(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date").cast("timestamp_ntz")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", day.alias("ds")).agg(F.sum("l_quantity").alias("y"))


# --- single events ------------------------------------------------------------------------------

STREAM_SPEC = SeriesSpec("ts", "value", (), ("event_id",))
USER_SPEC = SeriesSpec("ts", "value", ("user_id",), ("event_id",))


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def split_panel(df: DataFrame, spec: SeriesSpec) -> Panel:
    """A panel whose longest series is too long for a task, at any size of the tables."""
    panel = Panel.of(df, spec)
    return replace(panel, task_rows=max(panel.longest // 4, 1))


# --- output -------------------------------------------------------------------------------------


def rounded(name: str, digits: int = 6) -> Column:
    """Rounded, and without the sign of a zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def round_all(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits) if c in names else F.col(c) for c in df.columns])
