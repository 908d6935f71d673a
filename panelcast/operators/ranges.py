"""Closed date ranges: filters, unions of ranges with repeats, and ranges per series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import moment
from ..plans.ordered import Panel
from ..spec import DateRange


def in_range(df: DataFrame, date: str, date_range: DateRange) -> DataFrame:
    start, end = date_range.bounds()
    return df.filter(F.col(date).between(moment(start), moment(end)))


def in_ranges(df: DataFrame, date: str, ranges: list[DateRange]) -> DataFrame:
    """The union of range filters, with ``range_id``; a row comes once for every range that holds it.

    No join: the ranges are constants of the expression, and the plain filter before it can be pushed
    to the source.
    """
    if not ranges:
        return df.withColumn("range_id", F.lit(0)).filter(F.lit(False))
    holds = [F.col(date).between(*map(moment, r.bounds())) for r in ranges]
    hit = df.filter(reduce(lambda a, b: a | b, holds))
    if len(ranges) == 1:
        return hit.withColumn("range_id", F.lit(0))
    ids = F.array_compact(F.array(*[F.when(held, i) for i, held in enumerate(holds)]))
    return hit.withColumn("range_id", F.explode(ids))


def in_series_ranges(panel: Panel, ranges: DataFrame, kind: str) -> DataFrame:
    """As ``in_ranges`` with the ranges of a table (series keys, range_id, kind, start, end).

    The ranges of a series come as one array, so each row is joined once whatever the number of ranges.
    """
    keys, date = panel.spec.keys, F.col(panel.spec.date)
    lists = (
        ranges.filter(F.col("kind") == kind)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("range_id", "start", "end")).alias("_ranges"))
    )
    held = F.filter("_ranges", lambda r: date.between(r["start"], r["end"]))
    ids = F.transform(held, lambda r: r["range_id"])
    return panel.attach(lists).select(*panel.df.columns, F.explode(ids).alias("range_id"))
