"""Holidays of a calendar table as regressors, summed only over the few rows that have any.

A row carries the numbers of its holidays instead of one column for each. Their part of a fit's matrix follows from sums per
series and set of holidays that fall on one day, so its cost grows with the rows on holidays, not with rows times holidays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.attach import attach
from ..plans.gram import DOUBLES, row_moments, symmetric
from ..plans.lineage import cut
from ..plans.ordered import Panel

#: The column with the numbers of a row's holidays.
MARKS = "_holidays"


@dataclass(frozen=True)
class Calendar:
    """Days with the numbers of their holidays, and the holidays' names in order. One coefficient each, so names are few."""

    days: DataFrame
    size: int
    names: list[str]

    @classmethod
    def of(cls, table: DataFrame) -> Calendar:
        """From (``holiday``, ``date``) and, where there are such columns, ``lower_window`` and ``upper_window``.

        The windows are days before (0 or less) and after the date; each day of them is a holiday of its own, named with its
        distance. Null names, dates and windows count as none; rows that repeat count once.
        """
        missing = {"holiday", "date"} - set(table.columns)
        if missing:
            raise ValueError(f"The table of holidays has no column {sorted(missing)[0]}")
        lower, upper = (F.coalesce(F.col(name), F.lit(0)).cast("int") if name in table.columns else F.lit(0) for name in ("lower_window", "upper_window"))
        away = F.explode(F.sequence(F.least(lower, F.lit(0)), F.greatest(upper, F.lit(0)))).alias("_away")
        dated = table.select(F.col("holiday").cast("string").alias("_name"), F.col("date").cast("date").alias("_date"), away).dropna()
        named = F.when(F.col("_away") == 0, F.col("_name")).otherwise(F.concat("_name", F.format_string("_%+d", "_away")))
        listed = cut(dated.select(named.alias("_name"), F.date_add("_date", F.col("_away")).alias("_day")).distinct())
        names = sorted(row["_name"] for row in listed.select("_name").distinct().collect())
        number = F.array_position(F.array(*[F.lit(name) for name in names]).cast("array<string>"), F.col("_name")) - 1
        days = listed.groupBy("_day").agg(F.array_sort(F.collect_set(number.cast("int"))).alias(MARKS))
        return cls(days, days.count(), names)

    def marked(self, panel: Panel) -> DataFrame:
        """The panel's rows with ``MARKS``, empty on other days."""
        rows = panel.df.withColumn("_day", F.col(panel.spec.date).cast("date"))
        joined = attach(rows, self.days, ("_day",), self.size, null_keys=False).drop("_day")
        return joined.withColumn(MARKS, F.coalesce(MARKS, F.array().cast("array<int>")))


def effect(coef: Column, first: int) -> Column:
    """Sum of the coefficients of a row's holidays, which follow the ``first`` others."""
    return F.aggregate(F.transform(MARKS, lambda i: F.get(coef, i + first)), F.lit(0.0), lambda total, x: total + x)


SETS = T.StructType([T.StructField("marks", T.ArrayType(T.StringType())), T.StructField("sums", T.ArrayType(DOUBLES))])


def set_sums(rows: DataFrame, keys: tuple[str, ...], row: Column, width: int, size: Column) -> DataFrame:
    """Per fit ``_sets``: for each set of holidays on one day the sums of size squared, of size, and of size times the row.

    ``size`` is a holiday's value on its days. There are no more sets than days in the calendar.
    """
    some = rows.filter(F.size(MARKS) > 0).withColumn("_marks", F.array_join(MARKS, ","))
    scaled = F.concat(F.array(size * size, size), F.transform(row, lambda x: x * size))
    sums = row_moments(some, (*keys, "_marks"), scaled, width + 2).filter(F.col("n") > 0)
    totals = F.transform("mean", lambda x: x * F.col("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_marks").alias("marks"), totals.alias("sums"))))
    by_fit = sums.groupBy(*keys).agg(listed.alias("_l"))
    return by_fit.select(*keys, F.struct(F.col("_l.marks").alias("marks"), F.col("_l.sums").alias("sums")).cast(SETS).alias("_sets"))


def widened(n: int, mean: np.ndarray, products: np.ndarray, marks, sums, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred products with ``count`` holidays between the features and the target, from sums per set."""
    width = len(mean)
    total, along, cross = np.zeros(count), np.zeros((count, width)), np.zeros((count, count))
    for these, values in zip(marks, sums) if marks is not None else ():
        at = [int(mark) for mark in these.split(",")]
        total[at] += values[1]
        along[at] += np.asarray(values[2:])
        cross[np.ix_(at, at)] += values[0]
    dense = symmetric(products, width)
    full = np.zeros((width + count, width + count))
    order = [*range(width - 1), width + count - 1]
    full[np.ix_(order, order)] = dense
    here = np.arange(width - 1, width - 1 + count)
    between = along - np.outer(total, mean)
    full[np.ix_(here, order)], full[np.ix_(order, here)] = between, between.T
    full[np.ix_(here, here)] = cross - np.outer(total, total) / n
    return np.concatenate([mean[:-1], total / n, mean[-1:]]), full[np.triu_indices(width + count)]
