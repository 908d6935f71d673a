"""Statistics of the k rows before each row: mean, deviation, least and greatest.

A frame that slides would be worked out anew for every row. Instead the rows of a series are cut into chunks of k. A window of k
rows is the end of one chunk and the beginning of the next, so it is put together from two running aggregates: one that grows
from the start of a chunk and one that grows back from its end. Both take each row once, whatever k, and no sums are
subtracted, so nothing cancels. What is looked up, k rows back, comes by a lag.

Where a series is too long for a task, a chunk may be too. It is cut into blocks then: the aggregates run within blocks, the
totals of the blocks before or after are merged into them, and what is k rows back is sent to the place where it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Panel, add_position, look_back, placed_rows

STATISTICS = ("mean", "std", "min", "max")
#: Rows of a block of a long series, and blocks that a window is cut into at most.
BLOCK_ROWS, BLOCKS = 250_000, 1024


def _running(value: Column, window=None) -> Column:
    """The parts of all statistics over a window, or over a group."""
    over = (lambda part: part) if window is None else (lambda part: part.over(window))
    n = over(F.count(value)).cast("double")
    return F.struct(
        n.alias("n"),
        over(F.avg(value)).alias("mean"),
        (over(F.var_pop(value)) * n).alias("apart"),
        over(F.min(value)).alias("min"),
        over(F.max(value)).alias("max"),
    )


def _merged(a: Column, b: Column) -> Column:
    """The parts of two disjoint sets of rows as those of both together."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        ((a["n"] * a["mean"] + b["n"] * b["mean"]) / n).alias("mean"),
        (a["apart"] + b["apart"] + gap * gap * a["n"] * b["n"] / n).alias("apart"),
        F.least(a["min"], b["min"]).alias("min"),
        F.greatest(a["max"], b["max"]).alias("max"),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def _joined(a: Column, b: Column, alone: Column, k: int) -> dict[str, Column]:
    """Statistics of two parts together, or of ``a`` alone."""
    gap = a["mean"] - b["mean"]
    mean = F.when(alone, a["mean"]).otherwise((a["n"] * a["mean"] + b["n"] * b["mean"]) / k)
    apart = F.when(alone, a["apart"]).otherwise(a["apart"] + b["apart"] + gap * gap * a["n"] * b["n"] / k)
    return {
        "mean": mean,
        "std": F.sqrt(F.greatest(apart, F.lit(0.0)) / (k - 1)) if k > 1 else F.lit(None).cast("double"),
        "min": F.when(alone, a["min"]).otherwise(F.least(a["min"], b["min"])),
        "max": F.when(alone, a["max"]).otherwise(F.greatest(a["max"], b["max"])),
    }


def add_rolling(panel: Panel, wanted: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Add ``name -> (column, statistic, k)``: the statistic of the column over the k rows before the row, which is not among them.

    Null where fewer than k rows come before. ``std`` is the sample deviation, null for k = 1. Columns hold no nulls. Where a
    series is too long for a task, a task holds as many rows as a block, however long the window is.
    """
    for _, statistic, k in wanted.values():
        if statistic not in STATISTICS or k < 1:
            raise ValueError(f"A rolling statistic is one of {STATISTICS} over one row or more, not {statistic!r} over {k}")
    if not wanted:
        return panel.df
    kept = panel.df.columns
    pairs = sorted({(column, k) for column, _, k in wanted.values()})
    looked = _in_tasks(panel, pairs) if panel.fits_tasks else _in_blocks(panel, pairs)
    columns = []
    for name, (column, statistic, k) in wanted.items():
        number = pairs.index((column, k))
        full, alone = F.col("_at") > k, (F.col("_at") - 1) % k == 0
        columns.append(F.when(full, _joined(F.col(f"_a_{number}"), F.col(f"_b_{number}"), alone, k)[statistic]).alias(name))
    return looked.select(*[F.col(f"`{c}`") for c in kept], *columns)


def _in_tasks(panel: Panel, pairs: list[tuple[str, int]]) -> DataFrame:
    """``_at``, and per pair the parts ``_a_`` and ``_b_`` of the window before a row, or the whole of it in ``_a_``."""
    keys, df = panel.spec.keys, add_position(panel, "_at")
    for number, (column, k) in enumerate(pairs):
        value = F.col(f"`{column}`").cast("double")
        chunk = Window.partitionBy(*keys, F.floor((F.col("_at") - 1) / k)).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"_head_{number}", _running(value, chunk.orderBy("_at")))
        df = df.withColumn(f"_tail_{number}", _running(value, chunk.orderBy(F.col("_at").desc())))
    reach = max(k for _, k in pairs)

    def back(window) -> dict[str, Column]:
        made = {}
        for number, (_, k) in enumerate(pairs):
            made[f"_a_{number}"] = F.lag(f"_head_{number}", 1).over(window)
            made[f"_b_{number}"] = F.lag(f"_tail_{number}", k).over(window)
        return made

    return look_back(panel.on(df), reach, back)


def _in_blocks(panel: Panel, pairs: list[tuple[str, int]]) -> DataFrame:
    """As ``_in_tasks`` for series of any length and windows of any length."""
    placed = placed_rows(panel)
    first = placed.groupBy(*panel.spec.keys).agg(F.min("_place").alias("_first"))
    df = panel.on(placed).attach(first).withColumn("_at", F.col("_place") - F.col("_first") + 1).drop("_first")
    made = df
    for number, (column, k) in enumerate(pairs):
        rows = blocks(df, column, k, panel.task_rows)
        within = Window.partitionBy("_block")
        head = _running(F.col("_value"), within.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
        tail = _running(F.col("_value"), within.orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, 0))
        heads, tails = rows.withColumn("_head", head), rows.withColumn("_tail", tail)
        totals = rows.groupBy("_chunk", "_block").agg(_running(F.col("_value")).alias("_all"))
        heads = heads.join(_others(totals, F.col("_block")), "_block").withColumn("_head", _merged(F.col("_others"), F.col("_head")))
        tails = tails.join(_others(totals, F.col("_block").desc()), "_block").withColumn("_tail", _merged(F.col("_tail"), F.col("_others")))
        # Places of a series follow one another, so k rows on is k places on, or in another series, where ``_at`` is at most k.
        made = made.join(heads.select("_place", F.col("_head").alias(f"_a_{number}")), "_place")
        made = made.join(tails.select((F.col("_place") + k).alias("_place"), F.col("_tail").alias(f"_b_{number}")), "_place", "left")
        alone = (F.col("_at") - 1) % k == 0
        made = made.withColumn(f"_a_{number}", F.when(alone, F.col(f"_b_{number}")).otherwise(F.col(f"_a_{number}")))
    return made


def blocks(df: DataFrame, column: str, k: int, task_rows: int) -> DataFrame:
    """(_place, _value, _chunk, _block) of rows with ``_place`` and ``_at``: the places where their chunk of k rows and its block begin."""
    size, offset = max(min(task_rows, BLOCK_ROWS), -(-k // BLOCKS)), (F.col("_at") - 1) % k
    start, block = F.col("_place") - offset, F.col("_place") - offset % size
    return df.select("_place", F.col(f"`{column}`").cast("double").alias("_value"), start.alias("_chunk"), block.alias("_block"))


def _others(totals: DataFrame, order: Column) -> DataFrame:
    """(_block, _others): the merged totals of a chunk's blocks that come before a block in the given order."""
    earlier = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.struct(F.lit(0.0).alias("n"), *[F.lit(None).cast("double").alias(part) for part in ("mean", "apart", "min", "max")])
    listed = totals.select("_block", F.collect_list("_all").over(earlier).alias("_earlier"))
    return listed.select("_block", F.aggregate("_earlier", nothing, _merged).alias("_others"))
