"""Lower and upper bounds of forecasts.

A model whose parameters name an ``interval``, such as 0.95, gives two more columns: the bounds within which that share of
actual values is expected. Linear models and ARIMA propagate variances: of the noise and, for linear models, of the
coefficients. Boosted trees and the baseline take quantiles of their training residuals, which are merged from sketches.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.gram import DOUBLES, RANK_TOLERANCE, dot, regressions, symmetric
from ..spec import ModelSpec

#: Sketches of residuals keep ranks to one part in so many.
SKETCH = 10_000


def interval_of(model: ModelSpec) -> float | None:
    level = model.params.get("interval")
    if level is None:
        return None
    if not 0 < float(level) < 1:
        raise ValueError(f"interval lies between 0 and 1, not {level!r}")
    return float(level)


def deviations(level: float) -> float:
    """How many standard deviations on either side hold ``level`` of a normal distribution."""
    return NormalDist().inv_cdf((1 + level) / 2)


def around(prediction: Column, deviation: Column, level: float | None) -> tuple[Column, Column] | None:
    """Bounds of a normal forecast; null where the deviation is."""
    if level is None:
        return None
    reach = F.lit(deviations(level)) * deviation
    return prediction - reach, prediction + reach


SPREAD = T.StructType(
    [T.StructField("sd", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("centre", DOUBLES), T.StructField("root", DOUBLES)]
)


@F.pandas_udf(SPREAD)
def spread(n: pd.Series, mean: pd.Series, products: pd.Series, scale: pd.Series, centre: pd.Series) -> pd.DataFrame:
    """What the variance of a regression's forecast is made of, from the rows of ``moments``.

    Columns were summed as (value - centre) / scale. ``sd`` is the noise's deviation, with one degree of freedom less for the
    constant and each independent feature, null without any left; ``root`` (by rows) times its transpose is the
    generalised inverse of the features' centred products.
    """
    rows = [regression_spread(*row) for row in zip(n, map(np.asarray, mean), map(np.asarray, products), map(np.asarray, scale), map(np.asarray, centre))]
    return pd.DataFrame(rows, columns=["sd", "n", "centre", "root"])


def regression_spread(n: int, mean: np.ndarray, products: np.ndarray, scale: np.ndarray, centre: np.ndarray) -> tuple:
    g = symmetric(products, len(mean)) * np.outer(scale, scale)
    gram, total = g[:-1, :-1], g[-1, -1]
    coef = regressions(np.array([n]), (mean * scale + centre)[None], g[np.triu_indices(len(mean))][None], True)[0][0]
    length = np.sqrt(np.diag(gram))
    live = length > 0
    root = np.zeros(gram.shape)
    rank = 0
    if live.any():
        values, vectors = np.linalg.eigh(gram[np.ix_(live, live)] / np.outer(length[live], length[live]))
        kept = values > RANK_TOLERANCE * values[-1]
        rank = int(kept.sum())
        part = np.zeros((len(gram), rank))
        part[live] = vectors[:, kept] / np.sqrt(values[kept]) / length[live][:, None]
        root[:, :rank] = part
    free = n - rank - 1
    left = max(total - 2 * coef @ g[:-1, -1] + coef @ gram @ coef, 0.0)
    return (float(np.sqrt(left / free)) if free > 0 else None), int(n), (mean * scale + centre)[:-1], root.T.ravel()


def regression_deviation(names: list[str], fit: str) -> Column:
    """Standard deviation of a row's forecast: noise, constant and coefficients."""
    inside = F.array(*[F.col(f"`{name}`") - F.col(f"{fit}.centre")[i] for i, name in enumerate(names)]).cast("array<double>")
    width = len(names)

    def along(total: Column, i: Column) -> Column:
        part = dot(F.slice(F.col(f"{fit}.root"), i * width + 1, width), inside)
        return total + part * part

    leverage = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0.0), along) if width else F.lit(0.0)
    return F.col(f"{fit}.sd") * F.sqrt(1 + 1 / F.col(f"{fit}.n") + leverage)


def residual_quantiles(rows: DataFrame, residual: Column, level: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per fit key ``_bounds``: the two quantiles of the residuals that hold ``level`` between them. One pass, sketches merge."""
    shares = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    return rows.groupBy(*keys).agg(F.percentile_approx(residual, shares, F.lit(SKETCH)).alias("_bounds"))
