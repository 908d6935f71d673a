"""What a table holds: spacing of its dates, its target, its other columns, and a default split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import epoch_micros, iso_text
from ..plans.lineage import cut
from ..plans.ordered import Panel, add_lags
from ..spec import SeriesSpec
from .clean import type_label

MINUTE, HOUR, DAY = 60, 3_600, 86_400
# Below so many seconds of median distance, this code, label and expected distance in
# seconds. None means the median itself, a unit means its nearest multiple.
FREQUENCIES = (
    (MINUTE, "s", "Secondly", None, None),
    (HOUR, "min", "Minutely", MINUTE, None),
    (DAY, "H", "Hourly", HOUR, None),
    (7 * DAY, "D", "Daily", None, DAY),
    (30 * DAY, "W", "Weekly", None, 7 * DAY),
    (float("inf"), "M", "Monthly", None, 30 * DAY),
)
GAP_TOLERANCE = 1.5


def date_steps(panel: Panel) -> DataFrame:
    """Series keys and ``step``, the seconds from the row before; the first row of a series has none."""
    date = panel.spec.date
    narrow = panel.on(panel.df.select(*dict.fromkeys((*panel.spec.keys, *panel.spec.order))))
    lagged = add_lags(narrow, {"_before": (date, 1)})
    step = (epoch_micros(F.col(date)) - epoch_micros(F.col("_before"))) / F.lit(1e6)
    return lagged.filter(F.col("_before").isNotNull()).select(*panel.spec.keys, step.alias("step"))


#: Parts into which a bracket around a median is divided in one pass.
BINS = 4096


def median_step(panel: Panel, steps: DataFrame) -> DataFrame:
    """Exact median step per series.

    Series that fit a task use the median aggregate. For longer ones a bracket around the median is narrowed: each pass counts
    the steps in ``BINS`` parts of the bracket and goes on with the part that holds the middle, until a single value is left.
    A pass reads the written steps and adds up counts; nothing is put in order.
    """
    keys = panel.spec.keys
    if panel.fits_tasks:
        return steps.groupBy(*keys).agg(F.median("step").alias("median_step"))
    ends = steps.groupBy(*keys).agg(F.min("step").alias("_low"), F.max("step").alias("_high"), F.count("step").alias("_n")).filter("_n > 0")
    state = cut(ends.withColumns({"_below": F.lit(0).cast("long"), "_rank": F.floor((F.col("_n") + 1) / 2)}))
    while True:
        wide = state.filter("_high > _low")
        if wide.isEmpty():
            break
        inside = panel.attach_to(steps, wide).filter((F.col("step") >= F.col("_low")) & (F.col("step") <= F.col("_high")))
        part = F.least(F.floor((F.col("step") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*keys, part.alias("_part")).agg(
            F.count("step").alias("_c"), F.min("step").alias("_from"), F.max("step").alias("_to"),
            *[F.first(c).alias(c) for c in ("_n", "_below", "_rank")],
        )
        # At most BINS rows per series.
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", F.col("_below") + upto)
        middle = counts.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
        narrowed = middle.select(*keys, F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_n", (F.col("_upto") - F.col("_c")).alias("_below"), "_rank")
        state = cut(state.filter("_high = _low").unionByName(narrowed))
    found = panel.attach_to(steps, state.select(*keys, "_low", "_n"))
    sides = found.groupBy(*keys).agg(
        F.first("_low").alias("_low"), F.first("_n").alias("_n"), F.count_if(F.col("step") <= F.col("_low")).alias("_upto"),
        F.min(F.when(F.col("step") > F.col("_low"), F.col("step"))).alias("_next"),
    )
    both = F.when(F.col("_upto") >= F.ceil((F.col("_n") + 1) / 2), F.col("_low")).otherwise((F.col("_low") + F.col("_next")) / 2)
    return sides.select(*keys, both.alias("median_step"))


def frequency(panel: Panel) -> DataFrame:
    """Per series: frequency code and label from the median step, and the number of gaps.

    A gap is one step longer than 1.5 times the expected one, however many dates it leaves out. Series
    with fewer than two rows are ``unknown``.
    """
    keys = panel.spec.keys
    steps = date_steps(panel)
    if not panel.fits_tasks:
        steps = cut(steps)
    medians = median_step(panel, steps)
    median = F.col("median_step")
    expected = _by_median(median, lambda row: _expected_step(median, *row[3:]), "double")
    long_step = F.col("step") > F.col("_expected") * GAP_TOLERANCE
    gaps = (
        panel.attach_to(steps, medians.withColumn("_expected", expected))
        .groupBy(*keys)
        .agg(F.first("median_step").alias("median_step"), F.count_if(long_step).alias("gaps"))
    )
    everyone = panel.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    found = panel.attach_to(everyone, gaps)
    code = _by_median(median, lambda row: F.lit(row[1]), "string")
    label = _by_median(median, lambda row: F.lit(row[2]), "string")
    return found.select(
        *keys,
        F.coalesce(code, F.lit("unknown")).alias("frequency"),
        F.coalesce(label, F.lit("Unknown")).alias("frequency_label"),
        "median_step",
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
    )


def _by_median(median: Column, value: Callable[[tuple], Column], data_type: str) -> Column:
    branches = F.when(median.isNull(), F.lit(None).cast(data_type))
    for row in FREQUENCIES:
        branches = branches.when(median < F.lit(float(row[0])), value(row).cast(data_type))
    return branches


def _expected_step(median: Column, unit: int | None, fixed: int | None) -> Column:
    if fixed:
        return F.lit(fixed)
    return F.bround(median / unit) * unit if unit else median


def series_stats(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series: date span, rows, and the target's nulls, least, greatest and mean (0 where all null)."""
    y = F.col(spec.target)
    return df.groupBy(*spec.keys).agg(
        F.min(spec.date).alias("date_min"),
        F.max(spec.date).alias("date_max"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(y.isNull()).alias("missing_values_target"),
        F.coalesce(F.min(y), F.lit(0.0)).alias("value_min"),
        F.coalesce(F.max(y), F.lit(0.0)).alias("value_max"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("value_mean"),
    )


def dataset_stats(panel: Panel) -> DataFrame:
    """Everything the analysis reports per series, in one table."""
    steps = frequency(panel).drop("median_step").withColumnRenamed("gaps", "missing_dates")
    return panel.attach_to(series_stats(panel.df, panel.spec), steps)


def column_info(df: DataFrame, spec: SeriesSpec, samples: int = 5) -> DataFrame:
    """Per other column: type label, number of nulls and its first non-null values in date order, as text.

    One scan at any width: a task keeps the first values of every column and counts its nulls, and what tasks kept, a few
    rows per column, is merged.
    """
    others = [name for name in df.columns if name not in (spec.date, spec.target)]
    if not others:
        return df.sparkSession.createDataFrame([], "name string, dtype string, missing_count long, sample_values array<string>")
    order = list(dict.fromkeys((*spec.order, *spec.keys)))
    places = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(
        *[F.col(f"`{name}`").alias(place) for name, place in zip(order, places)],
        *[F.col(f"`{name}`").cast("string").alias(f"_v{i}") for i, name in enumerate(others)],
    )
    fields = [narrow.schema[place] for place in places]
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("nulls", T.LongType()), *fields, T.StructField("value", T.StringType())])
    first = narrow.mapInArrow(_first_values(places, len(others), samples), schema)
    row = F.when(F.col("value").isNotNull(), F.struct(*places, "value"))
    merged = first.groupBy("at").agg(F.sum("nulls").alias("missing_count"), F.slice(F.array_sort(F.collect_list(row)), 1, samples).alias("_rows"))
    labels = [F.struct(F.lit(i).alias("at"), F.lit(name).alias("name"), F.lit(type_label(df.schema[name].dataType)).alias("dtype")) for i, name in enumerate(others)]
    named = df.sparkSession.range(1).select(F.inline(F.array(*labels)))
    # Both sides hold one row per column of the table.
    values = F.when(F.size("_rows") > 0, F.transform("_rows", lambda r: r["value"])).otherwise(F.array().cast("array<string>"))
    out = named.join(F.broadcast(merged), "at", "left")
    return out.select("name", "dtype", F.coalesce("missing_count", F.lit(0)).alias("missing_count"), F.coalesce(values, F.array().cast("array<string>")).alias("sample_values"))


def _first_values(places: list[str], width: int, samples: int):
    """Per task and column: the number of nulls, and the first values in the order of ``places``."""
    keys = [(place, "ascending") for place in places]

    def first_of(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start")[:samples])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nulls, held, schema = [0] * width, [None] * width, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            ordered = pc.sort_indices(pa.Table.from_batches([batch]).select(places), sort_keys=keys, null_placement="at_start")
            for i in range(width):
                column = batch.column(len(places) + i)
                nulls[i] += column.null_count
                if column.null_count == len(column):
                    continue
                some = ordered.filter(column.is_valid().take(ordered))[:samples]
                part = pa.Table.from_arrays([batch.column(p).take(some) for p in range(len(places))] + [column.take(some)], [*places, "value"])
                held[i] = part if held[i] is None else first_of(pa.concat_tables([held[i], part]))
        for i in range(width if schema else 0):
            count = 0 if held[i] is None else held[i].num_rows
            # The nulls come on a row of their own.
            at, missing = pa.array([i] * (count + 1), pa.int32()), pa.array([nulls[i]] + [0] * count, pa.int64())
            columns = {}
            for place, name in enumerate([*places, "value"]):
                kept = [] if held[i] is None else held[i].column(name).chunks
                columns[name] = pa.concat_arrays([pa.nulls(1, schema.field(place).type), *kept])
            yield pa.RecordBatch.from_arrays([at, missing, *columns.values()], ["at", "nulls", *columns])

    return run


def normalised(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """ISO date text and target of the rows that have one."""
    y = F.col(spec.target)
    return df.filter(y.isNotNull()).select(*spec.keys, iso_text(F.col(spec.date)).alias("date"), y.alias("value"))


def default_split(df: DataFrame, spec: SeriesSpec, share: float = 0.8, share_split_day: bool = True) -> DataFrame:
    """Per series one training and one prediction range around the day at ``share`` of its valued rows.

    The day comes from row counts per day, so its window holds one row per calendar day however long the
    series. With ``share_split_day`` the split day ends training and also starts prediction.
    """
    keys, day = spec.keys, F.col(spec.date).cast("date")
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count(F.col(spec.target)).alias("_n"))
    series = Window.partitionBy(*keys)
    upto = F.sum("_n").over(series.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    marked = days.select(*keys, "_day", upto.alias("_upto"), F.sum("_n").over(series).alias("_all"))
    reached = F.col("_upto") > F.floor(F.col("_all") * F.lit(share))
    split = marked.groupBy(*keys).agg(
        F.min("_day").alias("_min"),
        F.max("_day").alias("_max"),
        F.coalesce(F.min(F.when(reached, F.col("_day"))), F.max("_day")).alias("_split"),
    )
    start = F.col("_split") if share_split_day else F.date_add("_split", 1)
    ranges = F.array(
        _range("train", F.col("_min"), F.col("_split")),
        _range("predict", start, F.col("_max")),
    )
    return split.select(*keys, F.inline(ranges))


def _range(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(0).alias("range_id"),
        F.lit(kind).alias("kind"),
        start.cast("timestamp_ntz").alias("start"),
        end.cast("timestamp_ntz").alias("end"),
    )
