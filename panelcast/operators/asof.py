"""Joining another table's latest values by date, for exogenous columns that come at dates of their own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Panel, carry_last


def join_asof(panel: Panel, other: DataFrame, columns: list[str], date: str | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The panel's rows with ``columns`` of the last row of ``other`` at or before their date; null where there is none.

    ``keys`` are those of the panel unless given: no keys means that one calendar serves all series. ``date`` is other's date
    column, called as the panel's unless given. Of several rows of ``other`` with one key and date the greatest values,
    compared column by column, count; rows with a null date do not. Null keys match each other.

    Both tables are put in one order and values are carried forward, so nothing is compared by range, and a series too
    long for a task is carried on from block to block.
    """
    spec = panel.spec
    keys = spec.keys if keys is None else keys
    if keys not in ((), spec.keys):
        raise ValueError(f"A table is joined on the series' keys or on none, not on {keys}")
    clash = [name for name in columns if name in panel.df.columns]
    if clash:
        raise ValueError(f"The panel has columns of these names already: {clash}")
    date = date or spec.date
    value = F.struct(*[F.col(f"`{name}`").alias(f"c{place}") for place, name in enumerate(columns)])
    there = other.filter(F.col(f"`{date}`").isNotNull()).select(*keys, F.col(f"`{date}`").cast("timestamp_ntz").alias(spec.date), value.alias("_value"))
    there = there.groupBy(*keys, spec.date).agg(F.max("_value").alias("_value")).withColumn("_from", F.lit(0))
    here = panel.df.withColumn("_from", F.lit(1))
    both = here.unionByName(there, allowMissingColumns=True)
    # At one date the other table's row comes first.
    joint = replace(spec, keys=keys, tiebreak=("_from", *spec.tiebreak))
    carried = carry_last(Panel.of(both, joint, panel.task_rows), "_carried", "_value")
    rows = carried.filter(F.col("_from") == 1)
    return rows.select(*[F.col(f"`{name}`") for name in panel.df.columns], *[F.col(f"_carried.c{place}").alias(name) for place, name in enumerate(columns)])
