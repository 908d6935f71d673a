"""Descriptions of a panel, its date ranges, its features and its models."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns hold the date, the target and the series.

    Without ``keys`` the table is one series. ``tiebreak`` columns order rows that share a date; dates
    that repeat within a series have no defined order without them.
    """

    date: str
    target: str
    keys: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.date, *self.tiebreak)

    @property
    def reserved(self) -> tuple[str, ...]:
        return (*self.keys, self.date, *self.tiebreak, self.target)


@dataclass(frozen=True)
class DateRange:
    """A closed range. A day without a time means midnight of that day, at both ends."""

    start: str
    end: str

    def bounds(self) -> tuple[datetime, datetime]:
        return _moment(self.start), _moment(self.end)


def _moment(text: str) -> datetime:
    try:
        moment = datetime.fromisoformat(text.strip())
    except (ValueError, AttributeError) as error:
        raise ValueError(f"Not a date or timestamp: {text!r}") from error
    if moment.tzinfo is not None:
        raise ValueError(f"Range ends carry no time zone: {text!r}")
    return moment


def parse_lags(lags: str | list[int] | tuple[int, ...]) -> list[int]:
    """Lags as a list, also from comma-separated text such as ``"1, 7"``."""
    parsed = [int(part) for part in (lags.split(",") if isinstance(lags, str) else lags)]
    if any(lag < 0 for lag in parsed):
        raise ValueError(f"Lags look back and cannot be negative: {parsed}")
    return list(dict.fromkeys(parsed))


@dataclass(frozen=True)
class Temporal:
    month: bool = False
    day_of_week: bool = False
    day_of_month: bool = False
    week_of_year: bool = False
    year: bool = False
    hour_of_day: bool = False
    minute_of_day: bool = False


@dataclass(frozen=True)
class Exogenous:
    column: str
    lags: list[int] = field(default_factory=list)
    use_actual: bool = False
    delta_lag: int | None = None
    pct_change_lag: int | None = None


@dataclass(frozen=True)
class Rolling:
    """A statistic (mean, std, min, max) of the target over the ``window_size`` rows before each row."""

    window_size: int
    operation: str

    @property
    def name(self) -> str:
        return f"target_{self.operation}_{self.window_size}"


DERIVED_OPERATIONS = ("sum", "difference", "product", "ratio")


@dataclass(frozen=True)
class Derived:
    operation: str
    feature_a: str
    feature_b: str
    alias: str | None = None

    def __post_init__(self) -> None:
        if self.operation not in DERIVED_OPERATIONS:
            raise ValueError(f"Unknown derived operation {self.operation!r}, expected one of {DERIVED_OPERATIONS}")

    @property
    def name(self) -> str:
        return self.alias or f"{self.feature_a}_{self.operation}_{self.feature_b}"


@dataclass(frozen=True)
class FeatureConfig:
    target_lags: list[int] = field(default_factory=lambda: [1, 7])
    temporal: Temporal = field(default_factory=Temporal)
    exogenous: list[Exogenous] = field(default_factory=list)
    derived: list[Derived] = field(default_factory=list)
    rolling: list[Rolling] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> FeatureConfig:
        return cls(
            target_lags=parse_lags(raw.get("target_lags", [1, 7])),
            temporal=Temporal(**raw.get("temporal", {})),
            exogenous=[Exogenous(**item) for item in raw.get("exogenous", [])],
            derived=[Derived(**item) for item in raw.get("derived", [])],
            rolling=[Rolling(**item) for item in raw.get("rolling_features", [])],
        )

    @classmethod
    def from_params(cls, params: dict[str, Any], default_lags: list[int]) -> FeatureConfig:
        """``feature_config`` wins over the short form ``lags``."""
        if "feature_config" in params:
            config = params["feature_config"]
            return config if isinstance(config, cls) else cls.from_dict(config)
        return cls(target_lags=parse_lags(params.get("lags", default_lags)))


@dataclass(frozen=True)
class ModelSpec:
    id: str
    type: str
    name: str
    params: dict[str, Any] = field(default_factory=dict)
