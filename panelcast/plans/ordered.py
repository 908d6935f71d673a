"""Row order within a series: lags and positions.

Two plans give the same rows. While every series fits one task, a window partitioned by series does it
in one shuffle. When a series is longer than that, the table is range-partitioned by (series, date,
tiebreak), so a long series spreads over many partitions, and each row gets its place in the overall
order from its place in its partition plus the sizes of the partitions before. Lags then run on blocks
of consecutive places, each block also holding the last rows of the block before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .attach import attach
from .lineage import cut

ROWS_PER_TASK_CONF = "spark.panelcast.rowsPerTask"
ROWS_PER_TASK = 2_000_000
# monotonically_increasing_id holds the partition above this many bits and the row's place below.
PLACE_BITS = 33


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK)))


@dataclass(frozen=True)
class Panel:
    """Rows with their series description and the measured sizes that choose the plans.

    ``task_rows`` is how many rows of a series one task may hold. ``ready`` names lag columns that are
    already there, so that several models share one ordering pass.
    """

    df: DataFrame
    spec: SeriesSpec
    rows: int
    series: int
    longest: int
    null_keys: bool
    task_rows: int
    ready: frozenset[str] = frozenset()

    @classmethod
    def of(cls, df: DataFrame, spec: SeriesSpec, task_rows: int | None = None) -> Panel:
        """Measure with one job that reads the key columns only."""
        sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
        without_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in spec.keys], F.lit(False))
        total = sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("series"),
            F.coalesce(F.max("n"), F.lit(0)).alias("longest"),
            F.coalesce(F.bool_or(without_key), F.lit(False)).alias("null_keys"),
        ).first()
        return cls(df, spec, *total, task_rows or rows_per_task(df.sparkSession))

    def on(self, df: DataFrame, spec: SeriesSpec | None = None) -> Panel:
        """The same panel over a frame with no more rows per series than before."""
        return replace(self, df=df, spec=spec or self.spec)

    @property
    def fits_tasks(self) -> bool:
        return self.longest <= self.task_rows

    def attach(self, per_series: DataFrame) -> DataFrame:
        return self.attach_to(self.df, per_series)

    def attach_to(self, df: DataFrame, per_fit: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
        """Left join of rows of this panel with a table that has one row per series, or for no keys one row."""
        keys = self.spec.keys if keys is None else keys
        return attach(df, per_fit, keys, self.series, not self.fits_tasks, self.null_keys)


def add_lags(panel: Panel, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Add ``name -> (column, k)``: the column's value k rows earlier in the series, null where none is.

    Lags count rows, not time. A lag of 0 is the value itself.
    """
    there = panel.ready & set(panel.df.columns)
    lags = {name: lag for name, lag in lags.items() if name not in there}
    now = {name: F.col(f"`{column}`") for name, (column, k) in lags.items() if k == 0}
    back = {name: lag for name, lag in lags.items() if lag[1] > 0}
    panel = panel.on(with_made(panel.df, now))
    if not back:
        return panel.df
    reach = max(k for _, k in back.values())
    return look_back(panel, reach, lambda w: {name: F.lag(F.col(f"`{column}`"), k).over(w) for name, (column, k) in back.items()})


def with_made(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """All columns and those made, which take the place of columns of the same name."""
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name not in made], *[c.alias(name) for name, c in made.items()])


def add_past(panel: Panel, name: str, column: str, reach: int) -> DataFrame:
    """Add an array of the column's values in this row and up to ``reach`` rows before, newest first, without nulls."""

    def newest_first(w: WindowSpec) -> dict[str, Column]:
        return {name: F.reverse(F.collect_list(column).over(w.rowsBetween(-reach, 0)))}

    return look_back(panel, reach, newest_first)


def look_back(panel: Panel, reach: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Add window columns that need no more than ``reach`` rows before their own.

    Rows that already have their ``_place`` in the whole order are not put in order again.
    """
    keys = panel.spec.keys
    if panel.fits_tasks:
        window = Window.partitionBy(*keys).orderBy(*panel.spec.order)
        return with_made(panel.df, columns(window))
    size = max(panel.task_rows, reach)
    block, last_rows = F.floor(F.col("_place") / size), F.col("_place") % size >= size - reach
    placed = panel.df if "_place" in panel.df.columns else placed_rows(panel)
    blocks = placed.select(
        "*",
        block.alias("_own"),
        F.explode(F.when(last_rows, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"),
    )
    window = Window.partitionBy("_block", *keys).orderBy("_place")
    looked = with_made(blocks, columns(window))
    return looked.filter(F.col("_own") == F.col("_block")).drop("_own", "_block", "_place")


def carry_last(panel: Panel, name: str, column: str) -> DataFrame:
    """Add the last value of ``column`` that is not null, in this row or before it in its series.

    Blocks of a long series are carried through one by one and then joined up: only the series that a block begins in the middle
    of takes a value from before it, so there are no more of these values than blocks.
    """
    keys = panel.spec.keys
    if panel.fits_tasks:
        so_far = Window.partitionBy(*keys).orderBy(*panel.spec.order).rowsBetween(Window.unboundedPreceding, 0)
        return panel.df.withColumn(name, F.last(column, ignorenulls=True).over(so_far))
    blocks = placed_rows(panel).withColumn("_block", F.floor(F.col("_place") / panel.task_rows))
    so_far = Window.partitionBy("_block", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn(name, F.last(column, ignorenulls=True).over(so_far))
    lasts = blocks.groupBy("_block", *keys).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_place"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).filter(F.col("_before").isNotNull())
    carried = carried.select(F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_block") == F.col("_b"))
    joined = local.join(F.broadcast(carried), match, "left")
    return joined.select(*panel.df.columns, F.coalesce(name, "_before").alias(name))


def add_position(panel: Panel, name: str) -> DataFrame:
    """Add the row's 1-based position in its series."""
    keys = panel.spec.keys
    if panel.fits_tasks:
        window = Window.partitionBy(*keys).orderBy(*panel.spec.order)
        return panel.df.withColumn(name, F.row_number().over(window).cast("long"))
    placed = placed_rows(panel)
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return panel.on(placed).attach(first).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def placed_rows(panel: Panel) -> DataFrame:
    """Add ``_place``, the row's 0-based position in the order (series, date, tiebreak) of the whole table."""
    df, order = panel.df, [*panel.spec.keys, *panel.spec.order]
    # Sorting spills and holds no series in memory, so short blocks need no more partitions than the session's bound.
    size = max(panel.task_rows, rows_per_task(df.sparkSession))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-panel.rows // size))
    # The written copy keeps partition ids and places fixed, whatever is recomputed later.
    ranged = cut(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: small whatever the table's size.
    starts = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_place", place)
        .drop("_part", "_start", "_id")
    )
