"""Frequency, gaps, spans, target statistics, column information and the default split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import profile
from panelcast.operators.clean import apply_cleaning, plan_cleaning
from panelcast.plans.ordered import Panel
from panelcast.spec import SeriesSpec

from .cleaning import RAW_SPEC, raw_orders
from .panels import (
    DAILY,
    DAILY_SPEC,
    HOURLY,
    HOURLY_SPEC,
    SHIP,
    SHIP_SPEC,
    STREAM_SPEC,
    USER_SPEC,
    daily,
    daily_panel,
    hourly_panel,
    round_all,
    ship,
    split_panel,
    stream,
    table,
)
from .registry import query


def _frequency_sql(source: str, key: str, date: str) -> str:
    """Steps, their median, class and gaps, for one panel."""
    by = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    join = f"USING ({key})" if key else "ON true"
    return f"""
  steps AS (SELECT {keys}epoch_us({date}) - LAG(epoch_us({date})) OVER ({by}ORDER BY {date}) AS us FROM {source}),
  med AS (SELECT {keys}MEDIAN(us / 1e6) AS median_step FROM steps WHERE us IS NOT NULL {group}),
  want AS (SELECT *, CASE WHEN median_step < 60 THEN median_step
      WHEN median_step < 3600 THEN round_even(median_step / 60, 0) * 60
      WHEN median_step < 86400 THEN round_even(median_step / 3600, 0) * 3600
      WHEN median_step < 604800 THEN 86400 WHEN median_step < 2592000 THEN 604800 ELSE 2592000 END AS expected FROM med),
  gap AS (SELECT {keys}CAST(COUNT(*) FILTER (us / 1e6 > expected * 1.5) AS BIGINT) AS gaps
      FROM steps JOIN want {join} WHERE us IS NOT NULL {group}),
  counted AS (SELECT {keys}COUNT(*) AS n FROM {source} {group}),
  freq AS (SELECT {keys}median_step,
      CASE WHEN median_step IS NULL THEN 'unknown' WHEN median_step < 60 THEN 's' WHEN median_step < 3600 THEN 'min'
           WHEN median_step < 86400 THEN 'H' WHEN median_step < 604800 THEN 'D' WHEN median_step < 2592000 THEN 'W' ELSE 'M' END AS frequency,
      CASE WHEN median_step IS NULL THEN 'Unknown' WHEN median_step < 60 THEN 'Secondly' WHEN median_step < 3600 THEN 'Minutely'
           WHEN median_step < 86400 THEN 'Hourly' WHEN median_step < 604800 THEN 'Daily' WHEN median_step < 2592000 THEN 'Weekly' ELSE 'Monthly' END AS frequency_label,
      COALESCE(gaps, 0) AS gaps
    FROM counted LEFT JOIN med {join} LEFT JOIN gap {join})"""


# The median of an even number of steps ends on half a microsecond.
_OUT = "frequency, frequency_label, CAST(ROUND(median_step * 2e6) AS BIGINT) AS half_micros, gaps"


def _shown(panel: Panel) -> DataFrame:
    half_micros = F.round(F.col("median_step") * 2e6).cast("long").alias("half_micros")
    return profile.frequency(panel).select(*panel.spec.keys, "frequency", "frequency_label", half_micros, "gaps")


@query(f"WITH {DAILY}, {_frequency_sql('daily', 'o_orderpriority', 'ds')} SELECT o_orderpriority, {_OUT} FROM freq")
def frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(daily_panel(spark, sf))


@query(f"WITH {HOURLY}, {_frequency_sql('hourly', 'event_type', 'ds')} SELECT event_type, {_OUT} FROM freq")
def frequency_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(hourly_panel(spark, sf))


@query(f"WITH {_frequency_sql('events', 'user_id', 'ts')} SELECT user_id, {_OUT} FROM freq")
def frequency_users(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular microsecond times of many series."""
    return _shown(Panel.of(stream(spark, sf), USER_SPEC))


@query(f"WITH {_frequency_sql('events', '', 'ts')} SELECT {_OUT} FROM freq")
def frequency_long_series(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series, spread over many tasks."""
    return _shown(split_panel(stream(spark, sf), STREAM_SPEC))


@query(f"WITH {SHIP}, {_frequency_sql('ship', 'l_returnflag', 'ds')} SELECT l_returnflag, frequency, gaps FROM freq")
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequency(Panel.of(ship(spark, sf), SHIP_SPEC)).select("l_returnflag", "frequency", "gaps")


@query(f"WITH {DAILY} SELECT o_orderpriority, MIN(ds) AS date_min, MAX(ds) AS date_max, COUNT(*) AS total_rows FROM daily GROUP BY 1")
def date_span(spark: SparkSession, sf: str) -> DataFrame:
    stats = profile.series_stats(daily(spark, sf), DAILY_SPEC)
    return stats.select("o_orderpriority", "date_min", "date_max", "total_rows")


_SPARSE = "CASE WHEN o_orderpriority = '5-LOW' OR n_orders = 1 THEN NULL ELSE y END"


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Daily orders with the target missing for single orders and for one whole series."""
    known = (F.col("o_orderpriority") != "5-LOW") & (F.col("n_orders") > 1)
    return daily(spark, sf).withColumn("y", F.when(known, F.col("y")))


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, {_SPARSE} AS y FROM daily)
  SELECT o_orderpriority, CAST(COUNT(*) - COUNT(y) AS BIGINT) AS missing_values_target, COALESCE(MIN(y), 0.0) AS value_min,
         COALESCE(MAX(y), 0.0) AS value_max, ROUND(COALESCE(AVG(y), 0.0), 4) AS value_mean FROM t GROUP BY 1""")
def target_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = profile.series_stats(_sparse(spark, sf), DAILY_SPEC)
    names = ["missing_values_target", "value_min", "value_max", "value_mean"]
    return round_all(stats.select("o_orderpriority", *names), ["value_mean"], 4)


@query(f"""WITH {DAILY}, {_frequency_sql('daily', 'o_orderpriority', 'ds')}
  SELECT o_orderpriority, MIN(ds) AS date_min, MAX(ds) AS date_max, COUNT(*) AS total_rows, CAST(0 AS BIGINT) AS missing_values_target,
         MIN(y) AS value_min, MAX(y) AS value_max, ROUND(AVG(y), 4) AS value_mean,
         ANY_VALUE(frequency) AS frequency, ANY_VALUE(frequency_label) AS frequency_label, ANY_VALUE(gaps) AS missing_dates
  FROM daily JOIN freq USING (o_orderpriority) GROUP BY 1""")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The whole profile of each series."""
    return round_all(profile.dataset_stats(daily_panel(spark, sf)), ["value_mean"], 4)


def _column_sql(name: str, label: str, source: str = "t") -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"""SELECT '{name}' AS name, '{label}' AS dtype, CAST(COUNT(*) - COUNT({name}) AS BIGINT) AS missing_count,
      (SELECT COALESCE(string_agg(v, '|' ORDER BY o_orderdate, o_orderkey), '') FROM (SELECT {text} AS v, o_orderdate, o_orderkey FROM {source}
        WHERE {name} IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 5)) AS sample_values FROM {source}"""


@query("WITH t AS (SELECT *, CASE WHEN o_custkey > 50 THEN o_orderstatus END AS status, o_totalprice > 100000 AS large,"
       " CAST(NULL AS VARCHAR) AS empty FROM orders) "
       + " UNION ALL ".join([_column_sql("o_orderkey", "numeric"), _column_sql("o_custkey", "numeric"), _column_sql("o_orderpriority", "string"),
                             _column_sql("status", "string"), _column_sql("large", "boolean"), _column_sql("empty", "string")]))
def column_info(spark: SparkSession, sf: str) -> DataFrame:
    """Samples are joined to one text, so that both sides compare plain values."""
    status = F.when(F.col("o_custkey") > 50, F.col("o_orderstatus")).alias("status")
    frame = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", status,
        (F.col("o_totalprice") > 100000).alias("large"), F.lit(None).cast("string").alias("empty"),
    )
    info = profile.column_info(frame, SeriesSpec("o_orderdate", "o_totalprice", (), ("o_orderkey",)))
    return info.withColumn("sample_values", F.array_join("sample_values", "|"))


@query(f"""WITH {DAILY} SELECT o_orderpriority, strftime(ds, '%Y-%m-%dT%H:%M:%S') AS date, y AS value
  FROM (SELECT o_orderpriority, ds, {_SPARSE} AS y FROM daily) WHERE y IS NOT NULL""")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return profile.normalised(_sparse(spark, sf), DAILY_SPEC)


def split_sql(source: str, key: str, date: str, y: str) -> str:
    """Day of the row at floor(0.8 n) of the rows with a target, between the first and the last day."""
    return f"""
  ends AS (SELECT {key}, MIN(CAST({date} AS DATE)) AS lo, MAX(CAST({date} AS DATE)) AS hi FROM {source} GROUP BY 1),
  numbered AS (SELECT {key}, CAST({date} AS DATE) AS d, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {date}) - 1 AS i,
                      COUNT(*) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {y} IS NOT NULL),
  cut AS (SELECT {key}, lo, hi, COALESCE(d, hi) AS d FROM ends LEFT JOIN
            (SELECT {key}, d FROM numbered WHERE i = CAST(FLOOR(0.8 * n) AS BIGINT)) USING ({key})),
  split AS (SELECT {key}, 0 AS range_id, 'train' AS kind, CAST(lo AS TIMESTAMP) AS start, CAST(d AS TIMESTAMP) AS "end" FROM cut
            UNION ALL SELECT {key}, 0, 'predict', CAST(d AS TIMESTAMP), CAST(hi AS TIMESTAMP) FROM cut)"""


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, {_SPARSE} AS y FROM daily), {split_sql('t', 'o_orderpriority', 'ds', 'y')}
  SELECT o_orderpriority, range_id, kind, start, "end" FROM split""")
def default_split(spark: SparkSession, sf: str) -> DataFrame:
    return profile.default_split(_sparse(spark, sf), DAILY_SPEC)


@query(f"WITH {split_sql('events', 'event_type', 'ts', 'value')} SELECT event_type, range_id, kind, start, \"end\" FROM split")
def default_split_events(spark: SparkSession, sf: str) -> DataFrame:
    """Many rows per day: the split comes from counts per day."""
    return profile.default_split(table(spark, sf, "events"), SeriesSpec("ts", "value", ("event_type",)))


@query("""SELECT o_orderpriority, COUNT(*) AS rows, MIN(d) AS first_day, MAX(d) AS last_day FROM
  (SELECT o_orderpriority, try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS d FROM orders
   WHERE o_orderdate >= TIMESTAMP '1995-03-01') GROUP BY 1""")
def analysed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning for analysis keeps rows without a target in the count."""
    raw = raw_orders(spark, sf)
    rows = apply_cleaning(raw, RAW_SPEC, plan_cleaning(raw, RAW_SPEC), drop_null_target=False)
    return rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
