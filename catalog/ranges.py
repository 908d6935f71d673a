"""Range filters, unions of overlapping ranges, and ranges per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.models.base import FixedRanges
from panelcast.models.lag import fit_lag
from panelcast.operators import ranges
from panelcast.operators.profile import default_split
from panelcast.spec import DateRange, ModelSpec

from .panels import DAILY, DAILY_SPEC, DAILY_W, PREDICT_SQL, daily, daily_panel, table
from .panels import PREDICT as PREDICT_RANGE
from .profiling import split_sql
from .registry import query

_OVERLAPPING = [DateRange("1995-01-01", "1997-06-30"), DateRange("1997-01-01", "1999-12-31"), DateRange("2000-05-01", "2000-05-31")]
_UNION_SQL = " UNION ALL ".join(
    f"SELECT *, {i} AS range_id FROM daily WHERE ds BETWEEN TIMESTAMP '{r.start}' AND TIMESTAMP '{r.end}'"
    for i, r in enumerate(_OVERLAPPING)
)


@query("SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:30:00'")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends are closed; the filter reaches the scan."""
    return ranges.in_range(table(spark, sf, "events"), "ts", DateRange("2024-01-05", "2024-01-09T12:30:00"))


@query(f"WITH {DAILY} {_UNION_SQL}")
def range_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in two ranges come twice."""
    return ranges.in_ranges(daily(spark, sf), "ds", _OVERLAPPING)


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS lag_1 FROM daily),
  u AS (SELECT *, 0 AS range_id FROM t WHERE {PREDICT_SQL}
        UNION ALL SELECT *, 1 FROM t WHERE ds BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-03-31')
  SELECT o_orderpriority, range_id, ds, lag_1 AS prediction, y AS actual FROM u WHERE lag_1 IS NOT NULL""")
def range_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Lags are made before ranges, and each range is scored in turn."""
    chosen = FixedRanges([PREDICT_RANGE], [PREDICT_RANGE, DateRange("2001-01-01", "2001-03-31")])
    fit = fit_lag(daily_panel(spark, sf), chosen, ModelSpec("lag", "LAG", "Lag"))
    return fit.forecast.drop("model_id", "model_name")


@query(f"""WITH {DAILY}, {split_sql('daily', 'o_orderpriority', 'ds', 'y')}
  SELECT daily.o_orderpriority, ds, y, range_id FROM daily JOIN split
    ON daily.o_orderpriority = split.o_orderpriority AND ds BETWEEN start AND "end" WHERE kind = 'predict'""")
def series_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Each series has its own prediction range from its own split."""
    panel = daily_panel(spark, sf)
    held = ranges.in_series_ranges(panel, default_split(panel.df, DAILY_SPEC), "predict")
    return held.select("o_orderpriority", "ds", "y", "range_id")
