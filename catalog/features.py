"""Every feature kind, residual targets, standardisation and null handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import features as feature_operators
from panelcast.operators.asof import join_asof
from panelcast.operators.features import RESIDUAL, add_residual_target, build_features, drop_incomplete, scaling
from panelcast.operators.ranges import in_ranges
from panelcast.plans.ordered import Panel, add_lags
from panelcast.plans.rolling import STATISTICS, add_rolling
from panelcast.spec import Derived, Exogenous, FeatureConfig, Rolling, Temporal

from .panels import (
    DAILY,
    DAILY_W,
    HOURLY,
    STREAM_SPEC,
    TRAIN,
    TRAIN_SQL,
    USER_SPEC,
    daily_panel,
    hourly_panel,
    round_all,
    split_panel,
    stream,
    table,
)
from .registry import query


def _daily(spark: SparkSession, sf: str, config: FeatureConfig, digits: int | None = 6) -> DataFrame:
    features = build_features(daily_panel(spark, sf), config)
    out = features.df.select("o_orderpriority", "ds", *features.names)
    return out if digits is None else round_all(out, features.names, digits)


def _hourly(spark: SparkSession, sf: str, temporal: Temporal) -> DataFrame:
    features = build_features(hourly_panel(spark, sf), FeatureConfig(target_lags=[], temporal=temporal))
    return round_all(features.df.select("event_type", "ds", *features.names), features.names)


def _cycle_sql(name: str, part: str, period: int) -> str:
    angle = f"2 * pi() * ({part}) / {period}"
    return f"ROUND(SIN({angle}), 6) + 0.0 AS {name}_sin, ROUND(COS({angle}), 6) + 0.0 AS {name}_cos"


# --- target lags --------------------------------------------------------------------------------


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds, LAG(y, 1) OVER {DAILY_W} AS target_lag_1, LAG(y, 7) OVER {DAILY_W} AS target_lag_7,
  LAG(y, 30) OVER {DAILY_W} AS target_lag_30, y AS target_lag_0 FROM daily""")
def target_lags(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, FeatureConfig(target_lags=[1, 7, 30, 0]), None)


@query("""SELECT event_id, ts, LAG(value, 1) OVER (ORDER BY ts, event_id) AS lag_1,
  LAG(value, 30) OVER (ORDER BY ts, event_id) AS lag_30 FROM events""")
def target_lags_halo(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series, in blocks over many tasks."""
    panel = split_panel(stream(spark, sf), STREAM_SPEC)
    return add_lags(panel, {"lag_1": ("value", 1), "lag_30": ("value", 30)}).select("event_id", "ts", "lag_1", "lag_30")


@query("""SELECT user_id, event_id, LAG(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_3 FROM events""")
def target_lags_halo_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Many series, some longer than a task may hold."""
    panel = split_panel(stream(spark, sf), USER_SPEC)
    return add_lags(panel, {"lag_3": ("value", 3)}).select("user_id", "event_id", "lag_3")


# --- calendar -----------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, {_cycle_sql('month', 'month(ds)', 12)} FROM daily")
def cyc_month(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, FeatureConfig(target_lags=[], temporal=Temporal(month=True)))


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, {_cycle_sql('dow', 'isodow(ds)', 7)} FROM daily")
def cyc_dow(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, FeatureConfig(target_lags=[], temporal=Temporal(day_of_week=True)))


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds, CAST(day(ds) AS INT) AS day_of_month, CAST(week(ds) AS INT) AS week_of_year,
  CAST(year(ds) AS INT) AS year FROM daily""")
def calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, FeatureConfig(target_lags=[], temporal=Temporal(day_of_month=True, week_of_year=True, year=True)), None)


@query(f"WITH {HOURLY} SELECT event_type, ds, {_cycle_sql('hour', 'hour(ds)', 24)} FROM hourly")
def cyc_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly(spark, sf, Temporal(hour_of_day=True))


@query(f"SELECT event_id, ts, {_cycle_sql('minute_of_day', 'hour(ts) * 60 + minute(ts)', 1440)} FROM events")
def cyc_minute(spark: SparkSession, sf: str) -> DataFrame:
    columns = feature_operators.temporal_columns(Temporal(minute_of_day=True), F.col("ts"))
    return round_all(stream(spark, sf).select("event_id", "ts", *[c.alias(n) for n, c in columns.items()]), list(columns))


# --- exogenous ----------------------------------------------------------------------------------


def _exog(**options) -> FeatureConfig:
    return FeatureConfig(target_lags=[], exogenous=[Exogenous(**options)])


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds, LAG(top_price, 1) OVER {DAILY_W} AS top_price_lag_1,
  LAG(top_price, 7) OVER {DAILY_W} AS top_price_lag_7 FROM daily""")
def exog_lag(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, _exog(column="top_price", lags=[1, 7]), None)


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, n_orders AS n_orders_actual FROM daily")
def exog_actual(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, _exog(column="n_orders", use_actual=True), None)


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, ROUND(top_price - LAG(top_price, 2) OVER {DAILY_W}, 6) + 0.0 AS top_price_delta_2 FROM daily")
def exog_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, _exog(column="top_price", delta_lag=2))


_PAST_SPREAD = f"LAG(spread, 1) OVER {DAILY_W}"


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds,
  CASE WHEN {_PAST_SPREAD} IS NOT NULL THEN (spread - {_PAST_SPREAD}) / GREATEST(ABS({_PAST_SPREAD}), 1e-10) END AS spread_pct_1 FROM daily""")
def exog_pct(spark: SparkSession, sf: str) -> DataFrame:
    """The spread is 0 on days with one order, which meets the guarded denominator."""
    return _daily(spark, sf, _exog(column="spread", pct_change_lag=1), None)


# --- derived ------------------------------------------------------------------------------------


def _derived(*derived: Derived, lags: tuple[int, ...] = ()) -> FeatureConfig:
    return FeatureConfig(target_lags=list(lags), derived=list(derived))


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, top_price + spread AS top_price_sum_spread FROM daily")
def derived_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, _derived(Derived("sum", "top_price", "spread")), None)


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, y - top_price AS rest, y * n_orders AS y_product_n_orders FROM daily")
def derived_diff_product(spark: SparkSession, sf: str) -> DataFrame:
    config = _derived(Derived("difference", "y", "top_price", "rest"), Derived("product", "y", "n_orders"))
    return _daily(spark, sf, config, None)


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, y / GREATEST(ABS(spread), 1e-10) AS y_ratio_spread FROM daily")
def derived_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf, _derived(Derived("ratio", "y", "spread")), None)


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS target_lag_1 FROM daily)
  SELECT o_orderpriority, ds, target_lag_1, y - target_lag_1 AS step,
    CASE WHEN target_lag_1 IS NOT NULL THEN (y - target_lag_1) / GREATEST(ABS(target_lag_1), 1e-10) END AS rate FROM t""")
def derived_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A derived feature of a lag, and one of that derived feature."""
    steps = Derived("difference", "y", "target_lag_1", "step"), Derived("ratio", "step", "target_lag_1", "rate")
    return _daily(spark, sf, _derived(*steps, lags=(1,)), None)


# --- targets and rows ---------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, LAG(y, 7) OVER {DAILY_W} AS target_lag_7, LAG(y, 2) OVER {DAILY_W} AS target_lag_2,"
       f" y - LAG(y, 2) OVER {DAILY_W} AS target_residual FROM daily")
def residual_target(spark: SparkSession, sf: str) -> DataFrame:
    features = add_residual_target(build_features(daily_panel(spark, sf), FeatureConfig(target_lags=[7])), 2)
    return features.df.select("o_orderpriority", "ds", *features.names, RESIDUAL)


@query(f"WITH {DAILY} SELECT o_orderpriority, ds, y, ROUND(y - LAG(y, 2) OVER {DAILY_W} + LAG(y, 2) OVER {DAILY_W}, 2) AS rebuilt FROM daily")
def residual_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Adding the lag to the residual gives the target again."""
    features = add_residual_target(build_features(daily_panel(spark, sf), FeatureConfig(target_lags=[])), 2)
    rebuilt = F.round(F.col(RESIDUAL) + F.col("target_lag_2"), 2)
    return features.df.select("o_orderpriority", "ds", "y", rebuilt.alias("rebuilt"))


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, LAG(y, 1) OVER {DAILY_W} AS target_lag_1, n_orders AS n_orders_actual FROM daily),
  c AS (SELECT o_orderpriority, AVG(target_lag_1) AS m1, STDDEV_POP(target_lag_1) AS s1, AVG(n_orders_actual) AS m2,
               STDDEV_POP(n_orders_actual) AS s2 FROM t WHERE {TRAIN_SQL} AND target_lag_1 IS NOT NULL GROUP BY 1)
  SELECT o_orderpriority, ds, ROUND((target_lag_1 - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) + 0.0 AS target_lag_1,
         ROUND((n_orders_actual - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) + 0.0 AS n_orders_actual
  FROM t JOIN c USING (o_orderpriority)""")
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    """Constants come from training rows and apply to all rows, per series."""
    config = FeatureConfig(target_lags=[1], exogenous=[Exogenous("n_orders", use_actual=True)])
    features = build_features(daily_panel(spark, sf), config)
    panel, keys, names = features.panel, features.panel.spec.keys, features.names
    train = drop_incomplete(in_ranges(panel.df, "ds", [TRAIN]), names)
    scaled = feature_operators.standardise(panel, panel.df, scaling(train, names, keys), names, keys)
    return round_all(scaled.select("o_orderpriority", "ds", *names), names)


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, LAG(y, 1) OVER {DAILY_W} AS target_lag_1, LAG(y, 30) OVER {DAILY_W} AS target_lag_30 FROM daily)
  SELECT * FROM t WHERE target_lag_30 IS NOT NULL""")
def drop_null_features(spark: SparkSession, sf: str) -> DataFrame:
    features = build_features(daily_panel(spark, sf), FeatureConfig(target_lags=[1, 30]))
    return drop_incomplete(features.df, features.names).select("o_orderpriority", "ds", *features.names)


# --- rolling statistics -------------------------------------------------------------------------


def _rolling_sql(value: str, order: str, k: int, name: str) -> str:
    """Means of amounts in hundredths have no fourth digit that is a tie; deviations are rounded to three."""
    frame = f"({order} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    functions = {"mean": ("AVG", 4), "std": ("STDDEV_SAMP", 3), "min": ("MIN", 4), "max": ("MAX", 4)}
    rounded = {s: f"ROUND({f}({value}) OVER {frame}, {digits}) + 0.0" for s, (f, digits) in functions.items()}
    parts = [f"CASE WHEN ROW_NUMBER() OVER ({order}) > {k} THEN {column} END AS {name.format(s)}" for s, column in rounded.items()]
    return ", ".join(parts)


_BY_DAY = "PARTITION BY o_orderpriority ORDER BY ds"


@query(f"""WITH {DAILY} SELECT o_orderpriority, ds, {_rolling_sql('y', _BY_DAY, 7, 'target_{}_7')}, {_rolling_sql('y', _BY_DAY, 30, 'target_{}_30')} FROM daily""")
def rolling_week(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, deviation, least and greatest of the 7 and 30 days before, as features."""
    rolling = [Rolling(k, statistic) for k in (7, 30) for statistic in STATISTICS]
    plain = _daily(spark, sf, FeatureConfig(target_lags=[], rolling=rolling), None)
    return round_all(round_all(plain, [f"target_std_{k}" for k in (7, 30)], 3), [f"target_mean_{k}" for k in (7, 30)], 4)


@query(f"""WITH size AS (SELECT GREATEST(COUNT(*) // 4, 1) * 3 AS k FROM events), e AS (SELECT event_id, ts, value, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS r FROM events),
  w AS (SELECT event_id, ts, r, k, AVG(value) OVER f AS m, STDDEV_SAMP(value) OVER f AS s, MIN(value) OVER f AS lo, MAX(value) OVER f AS hi FROM e, size
    WINDOW f AS (ORDER BY r RANGE BETWEEN k PRECEDING AND 1 PRECEDING))
  SELECT event_id, ts, CASE WHEN r > k THEN ROUND(m, 4) + 0.0 END AS mean, CASE WHEN r > k THEN ROUND(s, 4) + 0.0 END AS std,
    CASE WHEN r > k THEN lo END AS min, CASE WHEN r > k THEN hi END AS max FROM w""")
def rolling_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series in blocks over many tasks, with a window as long as three of them."""
    panel = split_panel(stream(spark, sf), STREAM_SPEC)
    rolled = add_rolling(panel, {s: ("value", s, panel.task_rows * 3) for s in STATISTICS})
    return round_all(rolled.select("event_id", "ts", *STATISTICS), ["mean", "std"], 4)


# --- values of another table as of a date -------------------------------------------------------


@query(f"""WITH {DAILY}, big AS (SELECT o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ds, MAX(o_totalprice) AS top FROM orders WHERE o_custkey % 10 = 0 GROUP BY 1, 2)
  SELECT d.o_orderpriority, d.ds, d.y, b.top FROM daily d ASOF LEFT JOIN big b ON d.o_orderpriority = b.o_orderpriority AND d.ds >= b.ds""")
def asof_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Each day with the last top price of a tenth of the customers, which come on days of their own."""
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    some = table(spark, sf, "orders").filter(F.col("o_custkey") % 10 == 0)
    big = some.groupBy("o_orderpriority", day.alias("ds")).agg(F.max("o_totalprice").alias("top"))
    return join_asof(daily_panel(spark, sf), big, ["top"]).select("o_orderpriority", "ds", "y", "top")


@query("""WITH other AS (SELECT ts, MAX(value) AS last_purchase FROM events WHERE user_id % 3 = 0 GROUP BY 1)
  SELECT e.event_id, e.user_id, e.ts, o.last_purchase FROM events e ASOF LEFT JOIN other o ON e.ts >= o.ts""")
def asof_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series, each with the last value of a third of the users, carried from block to block."""
    panel = split_panel(stream(spark, sf), STREAM_SPEC)
    other = stream(spark, sf).filter(F.col("user_id") % 3 == 0).select(F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    return join_asof(panel, other, ["last_purchase"], "at").select("event_id", "user_id", "ts", "last_purchase")


@query("""WITH other AS (SELECT ts, MAX(value) AS last_purchase FROM events WHERE user_id % 3 = 0 GROUP BY 1)
  SELECT e.event_id, e.user_id, e.ts, o.last_purchase FROM events e ASOF LEFT JOIN other o ON e.ts >= o.ts""")
def asof_users(spark: SparkSession, sf: str) -> DataFrame:
    """As ``asof_stream`` for a series per user that one calendar serves."""
    panel = Panel.of(stream(spark, sf), USER_SPEC)
    other = stream(spark, sf).filter(F.col("user_id") % 3 == 0).select("ts", F.col("value").alias("last_purchase"))
    return join_asof(panel, other, ["last_purchase"], keys=()).select("event_id", "user_id", "ts", "last_purchase")


# --- awkward names ------------------------------------------------------------------------------


@query(f"""WITH {DAILY}, t AS (SELECT o_orderpriority, ds, y, LAG(y, 1) OVER {DAILY_W} AS l1, LAG(top_price, 1) OVER {DAILY_W} AS p1, top_price FROM daily)
  SELECT o_orderpriority, ds, l1 AS lag_1, p1 AS price_lag_1, ROUND(top_price - p1, 4) + 0.0 AS price_delta_1, top_price AS price_now,
    ROUND(l1 + top_price, 4) AS both FROM t""".replace(" AS both FROM", ' AS "both" FROM'))
def awkward_names(spark: SparkSession, sf: str) -> DataFrame:
    """A column with a dot in its name, and one that is called like a feature, which takes its place."""
    panel = daily_panel(spark, sf)
    renamed = panel.df.withColumnRenamed("top_price", "price.top").withColumn("target_lag_1", F.lit(-1.0)).withColumn("price.top_actual", F.lit(-2.0))
    exogenous = [Exogenous("price.top", lags=[1], use_actual=True, delta_lag=1)]
    derived = [Derived("sum", "target_lag_1", "price.top_actual", "sum.of.both")]
    features = build_features(panel.on(renamed), FeatureConfig(target_lags=[1], exogenous=exogenous, derived=derived))
    names = {"target_lag_1": "lag_1", "price.top_lag_1": "price_lag_1", "price.top_delta_1": "price_delta_1", "price.top_actual": "price_now", "sum.of.both": "both"}
    out = features.df.select("o_orderpriority", "ds", *[F.col(f"`{name}`").alias(new) for name, new in names.items()])
    return round_all(out, ["price_delta_1", "both"], 4)
