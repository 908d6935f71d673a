"""The plan for long series gives the rows of the plan for short ones, and both those of plain Python."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.asof import join_asof
from panelcast.operators.profile import column_info, median_step
from panelcast.plans.attach import attach
from panelcast.plans.ordered import Panel, add_lags, add_past, add_position
from panelcast.plans.rolling import STATISTICS, add_rolling, blocks
from panelcast.spec import SeriesSpec

KEYED = SeriesSpec("ds", "y", ("key",), ("tie",))
SINGLE = SeriesSpec("ds", "y", (), ("tie",))


@pytest.fixture(scope="module")
def rows():
    """A third of the rows in one series, one of them without a key; dates repeat."""
    rng = np.random.default_rng(7)
    keys = ["hot"] * 300 + ["b"] * 5 + ["c"] * 1 + [None] * 60 + [f"s{i}" for i in range(200)]
    return [
        (key, datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 40))), tie, float(rng.normal()))
        for tie, key in enumerate(keys)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, ds timestamp_ntz, tie int, y double").repartition(5)


def expected(rows, keyed: bool, k: int) -> dict[int, tuple]:
    groups: dict = {}
    for key, ds, tie, y in rows:
        groups.setdefault(key if keyed else None, []).append((ds, tie, y))
    out = {}
    for group in groups.values():
        group.sort()
        for i, (_, tie, _) in enumerate(group):
            past = [y for _, _, y in group[max(0, i - 3) : i + 1]][::-1]
            out[tie] = (group[i - k][2] if i >= k else None, i + 1, past)
    return out


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("task_rows", [1_000_000, 64, 20])
def test_lags_and_positions(df, rows, keyed, task_rows):
    panel = Panel.of(df, KEYED if keyed else SINGLE, task_rows)
    assert panel.rows == len(rows) and panel.longest == (300 if keyed else len(rows))
    assert panel.fits_tasks == (panel.longest <= task_rows)
    out = add_lags(panel, {"lag": ("y", 9), "same": ("y", 0)})
    out = add_past(panel.on(out), "past", "y", 3)
    got = {r["tie"]: r for r in add_position(panel.on(out), "at").collect()}
    want = expected(rows, keyed, 9)
    assert {tie: (r["lag"], r["at"], r["past"]) for tie, r in got.items()} == want
    assert all(r["same"] == r["y"] for r in got.values())


def test_blocks_hold_bounded_rows(df):
    """No group of a window is larger than a block and its overlap, however hot the series."""
    from panelcast.plans import ordered

    panel = Panel.of(df, KEYED, 50)
    placed = ordered.placed_rows(panel)
    assert placed.agg(F.min("_place"), F.max("_place"), F.count_distinct("_place")).first()[:] == (0, 565, 566)
    sizes = placed.groupBy(F.floor(F.col("_place") / 50)).count().toPandas()["count"]
    assert sizes.max() <= 50


def test_short_blocks_need_no_more_partitions(spark, df):
    """Many short series cut into blocks of a few rows don't put the whole table in order in partitions of a few rows."""
    from panelcast.plans import ordered

    placed = ordered.placed_rows(Panel.of(df, KEYED, 2))
    assert placed.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert placed.agg(F.min("_place"), F.max("_place"), F.count_distinct("_place")).first()[:] == (0, 565, 566)


def test_ready_lags_are_not_made_again(df):
    panel = Panel.of(df, KEYED)
    first = add_lags(panel, {"lag": ("y", 2)})
    again = add_lags(replace(panel.on(first), ready=frozenset({"lag"})), {"lag": ("y", 2)})
    assert again.columns == first.columns


@pytest.mark.parametrize("keys", [(), ("key",)])
@pytest.mark.parametrize("rows_known", [1, 10_000_000])
@pytest.mark.parametrize("salted", [True, False])
def test_attach_joins_every_row_once(df, keys, rows_known, salted):
    sums = df.groupBy(*keys).agg(F.sum("tie").alias("total"))
    got = attach(df, sums, keys, rows_known, salted).select("tie", "key", "total").toPandas()
    want = df.toPandas().assign(total=lambda p: p.groupby(list(keys), dropna=False)["tie"].transform("sum") if keys else p["tie"].sum())
    merged = got.merge(want[["tie", "total"]], on="tie")
    assert len(got) == len(want) and (merged["total_x"] == merged["total_y"]).all()


def test_large_side_is_salted_and_small_side_broadcast(df):
    sums = df.groupBy("key").agg(F.sum("tie").alias("total"))
    small = attach(df, sums, ("key",), 1)._jdf.queryExecution().executedPlan().toString()
    large = attach(df, sums, ("key",), 10_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in small
    assert "_salt" in large and "broadcast" not in large


def test_rows_by_series_are_not_moved_again(spark, df):
    """With many series and none of them large, rows after lags meet per-series results where they are."""
    keyed = df.filter("key is not null")
    panel = replace(Panel.of(keyed, KEYED), series=10_000_000)
    assert not panel.null_keys and Panel.of(df, KEYED).null_keys
    lagged = add_lags(panel, {"lag": ("y", 1)})
    sums = keyed.groupBy("key").agg(F.sum("tie").alias("total"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = panel.attach_to(lagged, sums)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the lags and one for the sums, none for the join.
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("task_rows", [10_000, 50])
def test_rolling_equals_pandas(df, task_rows):
    panel = Panel.of(df, KEYED, task_rows)
    wanted = {f"{s}_{k}": ("y", s, k) for k in (1, 2, 7, 50, 170) for s in STATISTICS}
    got = add_rolling(panel, wanted).toPandas()
    order = [*panel.spec.order]
    frame = df.toPandas().sort_values(order)
    for name, (_, statistic, k) in wanted.items():
        want = frame.groupby("key", dropna=False)["y"].transform(lambda y, k=k, s=statistic: getattr(y.shift(1).rolling(k), s)())
        both = got[["tie", name]].merge(frame.assign(want=want)[["tie", "want"]], on="tie")
        assert len(both) == len(frame)
        assert np.allclose(both[name].astype(float), both["want"].astype(float), equal_nan=True, rtol=1e-9, atol=1e-9), name


def test_rolling_blocks_hold_bounded_rows(df):
    """A window longer than a task is cut into blocks that a task holds."""
    from panelcast.plans import ordered

    placed = ordered.placed_rows(Panel.of(df, SINGLE, 20)).withColumn("_at", F.col("_place") + 1)
    sizes = blocks(placed, "y", 170, 20).groupBy("_chunk", "_block").count().toPandas()
    assert sizes["count"].max() <= 20 and sizes["count"].sum() == 566 and sizes["_chunk"].nunique() == 4


def test_rolling_of_unknown_statistic(df):
    with pytest.raises(ValueError, match="median"):
        add_rolling(Panel.of(df, KEYED), {"x": ("y", "median", 3)})
    assert add_rolling(Panel.of(df, KEYED), {}).columns == df.columns


@pytest.mark.parametrize("task_rows", [10_000, 40])
@pytest.mark.parametrize("keys", [("key",), ()])
def test_asof_equals_pandas(df, task_rows, keys):
    panel = Panel.of(df, KEYED, task_rows)
    date = panel.spec.date
    other = df.filter(F.col("tie") % 9 == 0).select("key", F.col(date).alias("when"), (F.col("tie") * 2).alias("late"), F.lit(None).cast("int").alias("none"))
    other = other.union(other.filter("late % 4 = 0")).union(other.filter("late = 0").withColumn("when", F.lit(None).cast("timestamp_ntz")))
    got = join_asof(panel, other if keys else other.drop("key"), ["late", "none"], "when", keys).toPandas()
    frame, right = df.toPandas(), other.toPandas().dropna(subset=["when"])
    assert len(got) == len(frame)
    for row in got.itertuples():
        key = getattr(row, "key")
        same = right if not keys else right[right["key"].isna() if key is None or key != key else right["key"] == key]
        before = same[same["when"] <= getattr(row, date)]
        want = before[before["when"] == before["when"].max()]["late"].max() if len(before) else None
        assert (want is None and row.late != row.late) or row.late == want
    assert got["none"].isna().all()


def test_asof_refuses(df):
    panel = Panel.of(df, KEYED)
    with pytest.raises(ValueError, match="already"):
        join_asof(panel, df, ["y"])
    with pytest.raises(ValueError, match="keys or on none"):
        join_asof(panel, df.withColumnRenamed("y", "z"), ["z"], keys=("tie",))


def test_medians_of_long_series(spark):
    """Narrowing brackets gives the median of a sort, for even and odd counts, few and many distinct steps; nothing is sorted."""
    rng = np.random.default_rng(3)
    lists = {"even": rng.exponential(5, 400), "odd": rng.exponential(5, 401), "two": np.array([1.0] * 50 + [1000.0] * 50), "one": np.array([7.0]), "same": np.full(90, 3.5)}
    lists["tiny"] = 1e-6 * rng.integers(1, 10**6, 333)
    rows = [(key, float(step)) for key, values in lists.items() for step in values]
    steps = spark.createDataFrame(rows, "key string, step double").repartition(5).persist()
    panel = replace(Panel.of(steps.withColumnsRenamed({"step": "y"}).withColumn("ds", F.lit(None).cast("timestamp_ntz")).withColumn("tie", F.lit(0)), KEYED), task_rows=10)
    got = {row["key"]: row["median_step"] for row in median_step(panel, steps).collect()}
    assert got == {key: pytest.approx(float(np.median(values)), rel=1e-12) for key, values in lists.items()}
    whole = replace(panel, spec=SINGLE)
    everything = np.concatenate(list(lists.values()))
    assert median_step(whole, steps).first()["median_step"] == pytest.approx(float(np.median(everything)), rel=1e-12)


@pytest.mark.parametrize("width", [1, 40])
def test_column_samples_take_one_scan(spark, tmp_path, width):
    rows = [(datetime(2024, 1, 1) + timedelta(days=(i * 7) % 50), i, *[None if (i + j) % 3 else f"{j}-{i}" for j in range(width)]) for i in range(50)]
    names = [f"a.b{j}" for j in range(width)]
    path = str(tmp_path / f"t{width}")
    schema = "ds timestamp_ntz, y int, " + ", ".join(f"`{name}` string" for name in names)
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(path)
    info = column_info(spark.read.parquet(path), SeriesSpec("ds", "y"))
    assert info._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {row["name"]: row for row in info.collect()}
    for j, name in enumerate(names):
        values = sorted((row[0], row[2 + j]) for row in rows if row[2 + j] is not None)
        assert got[name]["sample_values"] == [value for _, value in values[:5]] and got[name]["missing_count"] == 50 - len(values)
    none = column_info(spark.read.parquet(path).limit(0), SeriesSpec("ds", "y")).collect()
    assert len(none) == width and all(row["missing_count"] == 0 and row["sample_values"] == [] for row in none)
