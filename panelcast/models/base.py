"""What every model returns, and the shape of its forecast."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import in_ranges, in_series_ranges
from ..plans.lineage import cut
from ..plans.ordered import Panel
from ..spec import DateRange, ModelSpec

class FixedRanges:
    """The same training and prediction ranges for every series."""

    def __init__(self, train: list[DateRange], predict: list[DateRange]) -> None:
        self._ranges = {"train": train, "predict": predict}
        self.most = max(len(train), len(predict), 1)

    def rows(self, panel: Panel, kind: str) -> DataFrame:
        return in_ranges(panel.df, panel.spec.date, self._ranges[kind])


class SeriesRanges:
    """Ranges of a table (series keys, range_id, kind, start, end), at most ``most`` of a kind per series."""

    def __init__(self, table: DataFrame, most: int = 1) -> None:
        self._table, self.most = table, most

    def rows(self, panel: Panel, kind: str) -> DataFrame:
        return in_series_ranges(panel, self._table, kind)


Ranges = FixedRanges | SeriesRanges


@dataclass(frozen=True)
class Fitted:
    """A model's tables: forecast, scored training rows, importances and attributions where it has any.

    ``no_rows`` is the error of a model whose ``train_scored`` turns out empty; ``skipped`` lists series
    that could not be fitted, with the reason; ``fits`` says per series how an iterative fit ended, ``effects`` what each
    holiday adds.
    """

    model: ModelSpec
    forecast: DataFrame
    train_scored: DataFrame | None = None
    no_rows: str | None = None
    importance: DataFrame | None = None
    attribution: dict[str, DataFrame] | None = None
    skipped: DataFrame | None = None
    fits: DataFrame | None = None
    effects: DataFrame | None = None


def as_forecast(
    df: DataFrame, panel: Panel, model: ModelSpec, prediction: Column, bounds: tuple[Column, Column] | None = None
) -> DataFrame:
    """model_id, model_name, range_id, series keys, date, prediction, actual, and with ``bounds`` lower and upper."""
    spec = panel.spec
    more = [] if bounds is None else [bound.cast("double").alias(name) for name, bound in zip(("lower", "upper"), bounds)]
    return df.select(
        F.lit(model.id).alias("model_id"),
        F.lit(model.name).alias("model_name"),
        "range_id",
        *spec.keys,
        spec.date,
        prediction.cast("double").alias("prediction"),
        F.col(spec.target).cast("double").alias("actual"),
        *more,
    )


def fitted(fits: DataFrame, message: str) -> DataFrame:
    """Write the fits, one small row each, so that scoring does not fit again; no fit at all is an error."""
    kept = cut(fits)
    if kept.isEmpty():
        raise ValueError(message)
    return kept


def unfitted(series: DataFrame, fits: DataFrame, keys: tuple[str, ...], reason: str) -> DataFrame:
    """Series without a fit, and why; null keys match each other."""
    done = fits.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return series.join(done, match, "left_anti").select(*keys, F.lit(reason).alias("reason"))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep rows that several passes of a fit read."""
    rows = df.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def importance_rows(fits: DataFrame, keys: tuple[str, ...], model: ModelSpec, names: list[str], values: str) -> DataFrame:
    """One row per fit and feature, largest first within a fit, ties in feature order."""
    listed = F.array(*[F.lit(name) for name in names])
    return fits.select(
        F.lit(model.id).alias("model_id"),
        *keys,
        F.posexplode(F.arrays_zip(listed.alias("feature"), F.col(values).alias("importance"))).alias("feature_pos", "_i"),
    ).select("model_id", *keys, "feature_pos", F.col("_i.feature").alias("feature"), F.col("_i.importance").alias("importance"))
