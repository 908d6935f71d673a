"""Walk-forward validation: a model is fitted before each of several dates and scored on the rows that follow.

Linear models need no refit and no second look at the training rows. All starts and ends of the folds' training ranges cut
time into segments; one pass over the rows gives the sums of products of every segment, and a fold's sums are those of the segments
it spans, merged around their joint mean. Merging gives what a difference of two prefix sums would, without its
cancellation. Only segments, whose number follows from the folds, are held per fit. Other models are fitted once for each fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import moment
from .models.base import FixedRanges, as_forecast
from .models.ols import fit_keys, linear_score
from .operators.evaluate import metrics
from .operators.features import drop_incomplete, training_features
from .operators.ranges import in_ranges
from .plans.gram import BUILT_IN_COLUMNS, DOUBLES, moments, regressions, row_moments
from .plans.lineage import cut
from .plans.ordered import Panel
from .run import TRAINERS
from .spec import DateRange, FeatureConfig, ModelSpec


@dataclass(frozen=True)
class Fold:
    """Rows from ``start`` (the beginning if None) up to but not including ``cut`` train; those from ``cut`` to ``end``, both included, are scored."""

    start: datetime | None
    cut: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.end < self.cut or (self.start is not None and self.start >= self.cut):
            raise ValueError(f"A fold's dates rise: {self.start}, {self.cut}, {self.end}")


def folds(first_cut: str, count: int, step_days: float, horizon_days: float | None = None, window_days: float | None = None) -> list[Fold]:
    """``count`` folds whose cuts lie ``step_days`` apart; each is scored over ``horizon_days`` (a step unless given).

    Training rows are all rows before the cut, or with ``window_days`` those of that many days before it.
    """
    if count < 1 or step_days <= 0:
        raise ValueError("There is one fold at least, and cuts lie apart")
    begin, out = datetime.fromisoformat(first_cut), []
    last = timedelta(microseconds=1)
    for number in range(count):
        at = begin + timedelta(days=number * step_days)
        start = None if window_days is None else at - timedelta(days=window_days)
        out.append(Fold(start, at, at + timedelta(days=horizon_days or step_days) - last))
    return out


FITS = T.ArrayType(T.StructType([T.StructField("coef", DOUBLES), T.StructField("intercept", T.DoubleType()), T.StructField("n", T.LongType())]))


def merged(n: np.ndarray, mean: np.ndarray, products: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred products (upper triangle) of several parts together."""
    total = int(n.sum())
    centre = (n[:, None] * mean).sum(axis=0) / total
    apart = mean - centre
    between = np.einsum("s,si,sj->ij", n.astype(float), apart, apart)
    return total, centre, products.sum(axis=0) + between[np.triu_indices(mean.shape[1])]


def _solved(spans: list[tuple[int, int]], width: int):
    """(segments, n, mean, products) -> coefficients of every fold; null for a fold without rows."""

    @F.pandas_udf(FITS)
    def solve(segments: pd.Series, n: pd.Series, mean: pd.Series, products: pd.Series) -> pd.Series:
        out = []
        for places, counts, means, cells in zip(segments, n, mean, products):
            places, counts = np.asarray(places), np.asarray(counts)
            means = np.array([np.asarray(m) for m in means]).reshape(-1, width)
            cells = np.array([np.asarray(c) for c in cells]).reshape(len(means), -1)
            fits = []
            for low, high in spans:
                inside = (places >= low) & (places < high)
                if not inside.any():
                    fits.append(None)
                    continue
                total, centre, sums = merged(counts[inside], means[inside], cells[inside])
                coef, intercept = regressions(np.array([total]), centre[None], sums[None], True)
                fits.append({"coef": coef[0], "intercept": float(intercept[0]), "n": total})
            out.append(fits)
        return pd.Series(out, dtype=object)

    return solve


def walk_linear(panel: Panel, model: ModelSpec, steps: list[Fold]) -> DataFrame:
    """Forecasts of a linear regression for every fold: columns of a forecast, ``range_id`` being the fold.

    Params are those of ``fit_ols`` but for ``standardize``, which changes no prediction, and ``interval``. A fold or
    series without training rows has no forecasts.
    """
    params, spec = model.params, panel.spec
    config = FeatureConfig.from_params(params, [1, 7])
    mode, residual_lag = params.get("target_mode", "raw"), int(params.get("residual_lag", 1))
    keys = fit_keys(panel, params)
    features, target = training_features(panel, config, mode, residual_lag)
    names, date = features.names, F.col(spec.date)
    complete = drop_incomplete(features.df, names)

    edges = sorted({fold.cut for fold in steps} | {fold.start for fold in steps if fold.start is not None})
    place = {edge: number + 1 for number, edge in enumerate(edges)}
    spans = [(0 if fold.start is None else place[fold.start], place[fold.cut]) for fold in steps]
    segment = reduce(lambda total, edge: total + (date >= moment(edge)).cast("int"), edges, F.lit(0))
    lowest = min((fold.start for fold in steps), key=lambda start: start or datetime.min)
    needed = date < moment(edges[-1])
    if lowest is not None:
        needed &= date >= moment(lowest)
    train = drop_incomplete(complete.filter(needed), [target]).withColumn("_segment", segment)

    columns = [*names, target]
    middle, spread = [0.0] * len(columns), [1.0] * len(columns)
    if len(columns) <= BUILT_IN_COLUMNS:
        sums = moments(train, (*keys, "_segment"), columns)
    else:
        # Wide sets are summed around 0, where columns far from it lose digits, so each is moved and scaled first.
        row = train.agg(F.array(*[F.avg(F.col(f"`{c}`")) for c in columns]), F.array(*[F.stddev_pop(F.col(f"`{c}`")) for c in columns])).first()
        middle, spread = [x or 0.0 for x in row[0]], [x or 1.0 for x in row[1]]
        scaled = [(F.col(f"`{c}`").cast("double") - middle[i]) / spread[i] for i, c in enumerate(columns)]
        sums = row_moments(train, (*keys, "_segment"), F.array(*scaled), len(columns))
    sums = sums.filter(F.col("n") > 0)

    # One row per fit with at most one small matrix per segment.
    parts = F.array_sort(F.collect_list(F.struct("_segment", "n", "mean", "products")))
    listed = sums.groupBy(*keys).agg(parts.alias("_parts")).filter(F.size("_parts") > 0)
    each = [F.col(f"_parts.{name}") for name in ("_segment", "n", "mean", "products")]
    fits = cut(listed.select(*keys, _solved(spans, len(columns))(*each).alias("_fits")))
    back = [spread[-1] / spread[i] for i in range(len(names))]

    test = in_ranges(complete, spec.date, [DateRange(str(fold.cut), str(fold.end)) for fold in steps])
    scored = panel.attach_to(test, fits, keys).withColumn("_fit", F.get("_fits", F.col("range_id"))).filter(F.col("_fit").isNotNull())
    coef = F.array(*[F.col("_fit.coef")[i] * back[i] for i in range(len(names))]).cast("array<double>")
    moved = F.col("_fit.intercept") * spread[-1] + middle[-1]
    for i in range(len(names)):
        moved = moved - F.col("_fit.coef")[i] * (back[i] * middle[i])
    scored = scored.withColumns({"coef": coef, "intercept": moved})
    prediction = linear_score(names)
    if mode == "residual":
        prediction = prediction + F.col(f"target_lag_{residual_lag}")
    return as_forecast(scored, panel, model, prediction)


def walk_forward(panel: Panel, models: list[ModelSpec], steps: list[Fold]) -> Iterator[tuple[ModelSpec, DataFrame]]:
    """Each model with its forecasts for every fold, ``range_id`` being the fold."""
    for model in models:
        if model.type == "LINEAR_REGRESSION" and "interval" not in model.params:
            yield model, walk_linear(panel, model, steps)
            continue
        if model.type not in TRAINERS:
            raise ValueError(f"Unknown model type {model.type}")
        parts = []
        for number, fold in enumerate(steps):
            before = fold.cut - timedelta(microseconds=1)
            train = DateRange(str(fold.start or datetime(1, 1, 1)), str(before))
            fit = TRAINERS[model.type](panel, FixedRanges([train], [DateRange(str(fold.cut), str(fold.end))]), model)
            parts.append(fit.forecast.withColumn("range_id", F.lit(number)))
        yield model, reduce(DataFrame.unionByName, parts)


def validation(panel: Panel, models: list[ModelSpec], steps: list[Fold], by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics per model and fold, and per column in ``by``, such as the series' keys: model_id, fold, cut, metrics, n."""
    tables = [
        metrics(cut(forecast), ("range_id", *by)).withColumn("model_id", F.lit(model.id)) for model, forecast in walk_forward(panel, models, steps)
    ]
    cuts = F.array(*[moment(fold.cut) for fold in steps])
    result = reduce(DataFrame.unionByName, tables)
    return result.withColumn("cut", F.get(cuts, F.col("range_id"))).withColumnRenamed("range_id", "fold")
