"""Seasonal orders of ARIMA: products of polynomials in the lag, whose coefficients are tied to one another.

(1 - a B)(1 - A B^s) w = e has lags 1, s and s + 1, but two coefficients. The sum of squares of any such model is a quadratic
form of its lags' sums of products, so the tied coefficients come from the same small matrix as free ones would, without
another pass over the rows. A forecast takes differences and lags together as one polynomial on the values themselves.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.gram import NOISY_FIT, least_squares, symmetric

#: Steps towards the tied coefficients, and the size of a step that ends them.
MOST_STEPS, SMALL_STEP = 200, 1e-11


@dataclass(frozen=True)
class Orders:
    """(p, d, q) and the seasonal (P, D, Q) with its period; a period of 0 is a model without a season."""

    ar: int
    differences: int
    ma: int
    season_ar: int = 0
    season_differences: int = 0
    season_ma: int = 0
    period: int = 0

    @classmethod
    def of(cls, params: Mapping) -> Orders:
        plain = [int(params.get(name, 1)) for name in "pdq"]
        season = [int(value) for value in params.get("seasonal_order") or (0, 0, 0, 0)]
        if len(season) != 4 or min(plain + season) < 0:
            raise ValueError(f"seasonal_order is (P, D, Q, period) and no order is negative, not {plain}, {season}")
        if not any(season[:3]):
            return cls(*plain)
        if season[3] < 2:
            raise ValueError(f"The period of seasonal_order is 2 or more, not {season[3]}")
        return cls(*plain, *season)

    @property
    def seasonal(self) -> bool:
        return self.period > 0

    @property
    def reach(self) -> int:
        """The longest lag of the differenced values."""
        return self.ar + self.season_ar * self.period

    @property
    def echo(self) -> int:
        """The longest lag of the residuals."""
        return self.ma + self.season_ma * self.period

    @property
    def steps(self) -> list[int]:
        """The lag of each difference taken."""
        return [1] * self.differences + [self.period] * self.season_differences

    @property
    def undone(self) -> int:
        """How many values the differences use up."""
        return sum(self.steps)

    @property
    def constant(self) -> bool:
        return not self.steps

    @property
    def ar_lags(self) -> list[int]:
        return self._lags(self.ar, self.season_ar)

    @property
    def ma_lags(self) -> list[int]:
        return self._lags(self.ma, self.season_ma)

    def _lags(self, plain: int, season: int) -> list[int]:
        return sorted({i + j * self.period for i in range(plain + 1) for j in range(season + 1)} - {0})

    def split(self, tied: np.ndarray) -> list[np.ndarray]:
        """Plain AR, seasonal AR, plain MA and seasonal MA coefficients."""
        return np.split(tied, np.cumsum([self.ar, self.season_ar, self.ma]))

    def __str__(self) -> str:
        season = f"({self.season_ar},{self.season_differences},{self.season_ma},{self.period})" if self.seasonal else ""
        return f"({self.ar},{self.differences},{self.ma}){season}"


def polynomial(coef: np.ndarray, every: int) -> np.ndarray:
    """1 and the coefficients of the powers ``every``, 2 ``every``, ..."""
    out = np.zeros(1 + len(coef) * every)
    out[0] = 1.0
    out[every::every] = coef
    return out


def _at(poly: np.ndarray, lags: list[int], shift: int = 0) -> np.ndarray:
    """The polynomial's coefficients at the lags, after a delay."""
    return np.array([poly[k - shift] if 0 <= k - shift < len(poly) else 0.0 for k in lags])


def expanded(orders: Orders, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ``ar_lags`` and ``ma_lags``, and their derivatives by the tied coefficients, one column each."""
    plain, season, echo, season_echo = orders.split(tied)
    ar, season_ar = polynomial(-plain, 1), polynomial(-season, max(orders.period, 1))
    ma, season_ma = polynomial(echo, 1), polynomial(season_echo, max(orders.period, 1))
    values = np.concatenate([-_at(np.convolve(ar, season_ar), orders.ar_lags), _at(np.convolve(ma, season_ma), orders.ma_lags)])
    upper, lower = np.zeros(len(orders.ar_lags)), np.zeros(len(orders.ma_lags))
    columns = [np.concatenate([_at(season_ar, orders.ar_lags, i), lower]) for i in range(1, orders.ar + 1)]
    columns += [np.concatenate([_at(ar, orders.ar_lags, j * orders.period), lower]) for j in range(1, orders.season_ar + 1)]
    columns += [np.concatenate([upper, _at(season_ma, orders.ma_lags, i)]) for i in range(1, orders.ma + 1)]
    columns += [np.concatenate([upper, _at(ma, orders.ma_lags, j * orders.period)]) for j in range(1, orders.season_ma + 1)]
    return values, np.column_stack(columns) if columns else np.zeros((len(values), 0))


def tied_regression(orders: Orders, gram: np.ndarray, cross: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """The tied coefficients of least squares by Gauss-Newton steps, halved until none raises the sum, and that sum."""

    def left(tied: np.ndarray) -> float:
        x = expanded(orders, tied)[0]
        return float(total - 2 * x @ cross + x @ gram @ x)

    tied = np.zeros(orders.ar + orders.season_ar + orders.ma + orders.season_ma)
    now = left(tied)
    for _ in range(MOST_STEPS if len(tied) else 0):
        x, slopes = expanded(orders, tied)
        step = least_squares(slopes.T @ gram @ slopes, slopes.T @ (cross - gram @ x))
        # Sums of squares agree to rounding long before coefficients do.
        while (then := left(tied + step)) > now + 1e-13 * total and np.abs(step).max() > SMALL_STEP:
            step = step / 2
        if not then <= now + 1e-13 * total:
            break
        tied, now = tied + step, then
        if np.abs(step).max() <= SMALL_STEP * (1 + np.abs(tied).max()):
            break
    return tied, max(now, 0.0)


def undifferenced(orders: Orders, ar: np.ndarray, season_ar: np.ndarray) -> np.ndarray:
    """Coefficients of the values' own lags 1, 2, ...: both AR polynomials and all differences multiplied out."""
    factors = [polynomial(-ar, 1), polynomial(-season_ar, max(orders.period, 1))]
    factors += [polynomial(np.array([-1.0]), lag) for lag in orders.steps]
    return -reduce(np.convolve, factors)[1:]


def tied_fit(orders: Orders, n: int, mean: np.ndarray, products: np.ndarray, stationary) -> tuple:
    """One row of ``moments`` over AR lags, MA lags and the value -> (coef of values and residuals, intercept, noise)."""
    g = symmetric(products, len(mean)) + (0 if orders.constant else n * np.outer(mean, mean))
    tied, left = tied_regression(orders, g[:-1, :-1], g[:-1, -1], g[-1, -1])
    ar, season_ar, ma, season_ma = orders.split(tied)
    ar, season_ar = stationary(ar), stationary(season_ar)
    free = n - len(tied) - orders.constant
    x = expanded(orders, np.concatenate([ar, season_ar, ma, season_ma]))[0]
    intercept = float(mean[-1] - x @ mean[:-1]) if orders.constant else 0.0
    echo = np.convolve(polynomial(ma, 1), polynomial(season_ma, max(orders.period, 1)))[1:]
    return np.concatenate([undifferenced(orders, ar, season_ar), echo]), intercept, left / free if free > 0 else None


def solve_tied(orders: Orders, stationary):
    """As ``solve_noise`` for tied coefficients; ``stationary`` reflects explosive roots of either AR polynomial."""

    @F.pandas_udf(NOISY_FIT)
    def solve(n: pd.Series, mean: pd.Series, products: pd.Series) -> pd.DataFrame:
        rows = [tied_fit(orders, int(a), np.asarray(b), np.asarray(c), stationary) for a, b, c in zip(n, mean, products)]
        return pd.DataFrame(rows, columns=["coef", "intercept", "noise"])

    return solve
