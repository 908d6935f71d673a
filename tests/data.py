"""Small inputs of the unit tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

# A month of daily values with one exogenous column.
VALUES = [100, 105, 102, 108, 115, 120, 125, 122, 118, 125, 130, 135, 140, 138, 132,
          135, 142, 148, 155, 160, 158, 152, 155, 162, 170, 175, 180, 178, 172, 175]
SPEND = [500, 450, 480, 520, 600, 580, 620, 550, 500, 530, 590, 610, 650, 600, 550,
         580, 620, 680, 700, 720, 690, 650, 660, 710, 750, 780, 800, 760, 720, 740]

SCHEMA = "key string, ds timestamp_ntz, y double"


def month(spark):
    rows = [(datetime(2023, 1, 1) + timedelta(days=i), float(v), float(s)) for i, (v, s) in enumerate(zip(VALUES, SPEND))]
    return spark.createDataFrame(rows, "date timestamp_ntz, value double, marketing_spend double")


def wave(days: int, seed: int = 0, level: float = 100.0) -> np.ndarray:
    """Trend, weekly and yearly waves and noise."""
    t = np.arange(days)
    rng = np.random.default_rng(seed)
    return level + 0.05 * t + 8 * np.sin(2 * np.pi * t / 7) + 15 * np.cos(2 * np.pi * t / 365.25) + rng.normal(0, 1, days)


def panel_rows(series: dict[str | None, np.ndarray], start: datetime = datetime(2020, 1, 1)) -> list[tuple]:
    return [(key, start + timedelta(days=i), float(v)) for key, values in series.items() for i, v in enumerate(values)]
