from __future__ import annotations

from datetime import datetime

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.analyse import analyse
from panelcast.models.base import FixedRanges, SeriesRanges
from panelcast.operators import profile
from panelcast.operators.features import RESIDUAL, build_features, training_features
from panelcast.operators.ranges import in_range, in_ranges
from panelcast.plans.ordered import Panel
from panelcast.spec import DateRange, Derived, Exogenous, FeatureConfig, SeriesSpec, Temporal, parse_lags

MONTH = SeriesSpec("date", "value")


@pytest.fixture(scope="module")
def month(spark):
    return Panel.of(data.month(spark), MONTH)


def test_month_of_values(month):
    """Lags, differences and changes of the sample month, by hand."""
    config = FeatureConfig(
        target_lags=[1, 7],
        temporal=Temporal(day_of_week=True, month=True, year=True),
        exogenous=[Exogenous("marketing_spend", [1], True, 1, 7)],
        derived=[Derived("ratio", "value", "marketing_spend", "per_spend"), Derived("sum", "per_spend", "year")],
    )
    features = build_features(month, config)
    assert features.names == [
        "target_lag_1", "target_lag_7", "month_sin", "month_cos", "dow_sin", "dow_cos", "year", "marketing_spend_lag_1",
        "marketing_spend_actual", "marketing_spend_delta_1", "marketing_spend_pct_7", "per_spend", "per_spend_sum_year",
    ]
    assert set(features.source.values()) == {"marketing_spend"} and len(features.source) == 4
    rows = features.df.orderBy("date").collect()
    eighth = rows[7]
    assert eighth["target_lag_1"] == 125 and eighth["target_lag_7"] == 100
    assert eighth["marketing_spend_delta_1"] == 550 - 620
    assert eighth["marketing_spend_pct_7"] == pytest.approx((550 - 500) / 500)
    assert eighth["per_spend_sum_year"] == pytest.approx(122 / 550 + 2023)
    # 8 January 2023 is a Sunday: the seventh day closes the circle.
    assert eighth["dow_cos"] == pytest.approx(1.0) and abs(eighth["dow_sin"]) < 1e-12
    assert rows[0]["target_lag_1"] is None and rows[6]["target_lag_7"] is None
    assert "_past_marketing_spend_1" not in features.df.columns


def test_month_profile(month):
    stats = profile.dataset_stats(month).first()
    assert (stats["frequency"], stats["frequency_label"], stats["missing_dates"]) == ("D", "Daily", 0)
    assert (stats["total_rows"], stats["value_min"], stats["value_max"]) == (30, 100.0, 180.0)
    split = {r["kind"]: (r["start"], r["end"]) for r in profile.default_split(month.df, MONTH).collect()}
    assert split == {
        "train": (datetime(2023, 1, 1), datetime(2023, 1, 25)),
        "predict": (datetime(2023, 1, 25), datetime(2023, 1, 30)),
    }
    later = {r["kind"]: r["start"] for r in profile.default_split(month.df, MONTH, share_split_day=False).collect()}
    assert later["predict"] == datetime(2023, 1, 26)


@pytest.mark.parametrize(
    "hours, code, gaps",
    [
        ([0], "unknown", 0),
        ([0, 1, 2, 3, 6, 7], "H", 1),
        ([0, 24, 48, 120], "D", 1),
        ([0, 168, 336, 504], "W", 0),
        ([0, 720, 1440], "M", 0),
        ([0, 0.25, 0.5, 1.5], "min", 1),
        ([0, 0.001, 0.002, 0.004], "s", 1),
    ],
)
@pytest.mark.parametrize("task_rows", [100, 2])
def test_frequencies(spark, hours, code, gaps, task_rows):
    df = spark.createDataFrame([(int(h * 3.6e9), 1.0) for h in hours], "us long, y double")
    df = df.select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("us") / 1e6)).alias("ds"), "y")
    row = profile.frequency(Panel.of(df, SeriesSpec("ds", "y"), task_rows)).first()
    assert (row["frequency"], row["gaps"]) == (code, gaps)


def test_empty_table(spark):
    df = spark.createDataFrame([], data.SCHEMA)
    panel = Panel.of(df, SeriesSpec("ds", "y", ("key",)))
    assert (panel.rows, panel.series, panel.longest) == (0, 0, 0)
    assert build_features(panel, FeatureConfig()).df.count() == 0
    assert profile.dataset_stats(panel).count() == 0


def test_missing_inputs_warn(month):
    config = FeatureConfig([1], exogenous=[Exogenous("no_such", [1])], derived=[Derived("sum", "value", "nothing")])
    with pytest.warns(UserWarning, match="skipped"):
        assert build_features(month, config).names == ["target_lag_1"]


def test_bad_configurations():
    with pytest.raises(ValueError, match="power"):
        Derived("power", "a", "b")
    with pytest.raises(ValueError):
        parse_lags("-1")
    assert parse_lags(" 1, 7,1") == [1, 7]
    assert FeatureConfig.from_params({"lags": "2,3"}, [1]).target_lags == [2, 3]
    assert FeatureConfig.from_params({"lags": "2", "feature_config": {}}, [9]).target_lags == [1, 7]
    assert FeatureConfig.from_params({}, [1, 7, 14, 30]).target_lags == [1, 7, 14, 30]


def test_ratio_guard(spark):
    rows = [(datetime(2024, 1, i + 1), 3.0, b) for i, b in enumerate([0.0, -2.0, None])]
    panel = Panel.of(spark.createDataFrame(rows, "ds timestamp_ntz, y double, b double"), SeriesSpec("ds", "y"))
    features = build_features(panel, FeatureConfig([], derived=[Derived("ratio", "y", "b")]))
    assert [r["y_ratio_b"] for r in features.df.orderBy("ds").collect()] == [3.0 / 1e-10, 1.5, None]


def test_residual_lag_joins_the_features_last(month):
    features, target = training_features(month, FeatureConfig([7], Temporal(year=True)), "residual", 2)
    assert target == RESIDUAL and features.names == ["target_lag_7", "year", "target_lag_2"]
    features, _ = training_features(month, FeatureConfig([2, 7]), "residual", 2)
    assert features.names == ["target_lag_2", "target_lag_7"]
    with pytest.raises(ValueError):
        training_features(month, FeatureConfig(), "other", 1)


def test_ranges(month):
    df = month.df
    assert in_range(df, "date", DateRange("2023-01-02", "2023-01-04")).count() == 3
    assert in_range(df, "date", DateRange("2023-01-02", "2023-01-03T23:00")).count() == 2
    both = in_ranges(df, "date", [DateRange("2023-01-01", "2023-01-05"), DateRange("2023-01-05", "2023-01-06")])
    assert sorted((r["range_id"], r["value"]) for r in both.filter("value = 115").collect()) == [(0, 115.0), (1, 115.0)]
    assert in_ranges(df, "date", []).count() == 0
    for bad in ("", "soon", "2023-13-01", "2023-01-01T00:00:00Z"):
        with pytest.raises(ValueError):
            in_range(df, "date", DateRange(bad, "2023-01-02"))


def test_range_filter_reaches_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = in_ranges(events, "ts", [DateRange("2024-01-05", "2024-01-06")])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan


def test_lags_share_one_ordering(spark, month):
    """Any number of lags costs one shuffle and one sort."""
    config = FeatureConfig([1, 2, 7], exogenous=[Exogenous("marketing_spend", [1, 3], delta_lag=2, pct_change_lag=5)])
    keyed = Panel.of(month.df.withColumn("k", F.lit("a")), SeriesSpec("date", "value", ("k",)))
    plan = build_features(keyed, config).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_series_ranges_equal_fixed_ones(spark):
    df = spark.createDataFrame(data.panel_rows({"a": np.arange(20), None: np.arange(20)}), data.SCHEMA)
    panel = Panel.of(df, SeriesSpec("ds", "y", ("key",)))
    fixed = FixedRanges([DateRange("2020-01-01", "2020-01-17")], [DateRange("2020-01-17", "2020-01-20")])
    table = SeriesRanges(profile.default_split(df, panel.spec))
    for kind in ("train", "predict"):
        rows = [sorted(r.rows(panel, kind).select(F.coalesce("key", F.lit("-")), "y").collect()) for r in (fixed, table)]
        assert rows[0] == rows[1] and len(rows[0]) > 0


def test_analysis_of_a_raw_table(spark):
    raw = data.month(spark).select(
        F.date_format("date", "MM/dd/yyyy").alias("date"),
        F.when(F.col("value") == 105, None).otherwise(F.concat(F.lit("$"), F.col("value").cast("int").cast("string"))).alias("value"),
        "marketing_spend",
    )
    found = analyse(raw, MONTH)
    stats = found.stats.first()
    assert (stats["total_rows"], stats["missing_values_target"], stats["frequency"]) == (30, 1, "D")
    assert found.points.count() == 29 and found.points.orderBy("date").first()["date"] == "2023-01-01T00:00:00"
    column = found.columns.first()
    assert (column["name"], column["dtype"], column["missing_count"]) == ("marketing_spend", "numeric", 0)
    assert column["sample_values"] == ["500.0", "450.0", "480.0", "520.0", "600.0"]
    assert {r["kind"] for r in found.ranges.collect()} == {"train", "predict"}
