"""Lag, calendar, exogenous and derived features; residual targets; standardisation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cycle, iso_weekday, minute_of_day
from ..functions.numbers import over_magnitude
from ..plans.ordered import Panel, add_lags
from ..plans.rolling import add_rolling
from ..spec import Derived, Exogenous, FeatureConfig, Temporal


@dataclass(frozen=True)
class Features:
    """A panel with feature columns, their names in order, and which exogenous column each comes from."""

    panel: Panel
    names: list[str]
    source: dict[str, str]

    @property
    def df(self) -> DataFrame:
        return self.panel.df


def temporal_columns(temporal: Temporal, ts: Column) -> dict[str, Column]:
    """Calendar features in their fixed order; cyclic parts give a sine and a cosine each."""
    columns: dict[str, Column] = {}

    def add_cycle(name: str, part: Column, period: int) -> None:
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cycle(part, period)

    if temporal.month:
        add_cycle("month", F.month(ts), 12)
    if temporal.day_of_week:
        add_cycle("dow", iso_weekday(ts), 7)
    if temporal.day_of_month:
        columns["day_of_month"] = F.dayofmonth(ts)
    if temporal.week_of_year:
        columns["week_of_year"] = F.weekofyear(ts)
    if temporal.year:
        columns["year"] = F.year(ts)
    if temporal.hour_of_day:
        add_cycle("hour", F.hour(ts), 24)
    if temporal.minute_of_day:
        add_cycle("minute_of_day", minute_of_day(ts), 1440)
    return columns


def derived_column(derived: Derived) -> Column:
    a, b = F.col(f"`{derived.feature_a}`"), F.col(f"`{derived.feature_b}`")
    if derived.operation == "sum":
        return a + b
    if derived.operation == "difference":
        return a - b
    if derived.operation == "product":
        return a * b
    return over_magnitude(a, b)


def _past(column: str, k: int) -> str:
    """Name under which a value k rows back is kept until differences are taken."""
    return f"_past_{column}_{k}"


def lag_columns(config: FeatureConfig, target: str, present: set[str]) -> dict[str, tuple[str, int]]:
    """Every lag the configuration needs, as ``name -> (column, k)``."""
    lags = {f"target_lag_{k}": (target, k) for k in config.target_lags}
    for exog in config.exogenous:
        if exog.column in present:
            lags |= {f"{exog.column}_lag_{k}": (exog.column, k) for k in exog.lags}
            steps = [k for k in (exog.delta_lag, exog.pct_change_lag) if k is not None]
            lags |= {_past(exog.column, k): (exog.column, k) for k in steps}
    return lags


def exogenous_columns(exog: Exogenous) -> dict[str, Column | None]:
    """Features of one exogenous column in their fixed order; lags are made elsewhere and stand as None."""
    c, columns = exog.column, dict.fromkeys(f"{exog.column}_lag_{k}" for k in exog.lags)
    if exog.use_actual:
        columns[f"{c}_actual"] = F.col(f"`{c}`")
    if (k := exog.delta_lag) is not None:
        columns[f"{c}_delta_{k}"] = F.col(f"`{c}`") - F.col(f"`{_past(c, k)}`")
    if (k := exog.pct_change_lag) is not None:
        columns[f"{c}_pct_{k}"] = over_magnitude(F.col(f"`{c}`") - F.col(f"`{_past(c, k)}`"), F.col(f"`{_past(c, k)}`"))
    return columns


def build_features(panel: Panel, config: FeatureConfig) -> Features:
    """Add every configured feature to the whole panel, before any date range is applied.

    All lags share one pass over the ordered rows. Missing exogenous columns and missing inputs of
    derived features are skipped with a warning; derived features may use earlier derived ones.
    """
    spec, present = panel.spec, set(panel.df.columns)
    lags = lag_columns(config, spec.target, present)
    made: dict[str, Column | None] = {f"target_lag_{k}": None for k in config.target_lags}
    rolling = {item.name: (spec.target, item.operation, item.window_size) for item in config.rolling}
    made |= dict.fromkeys(rolling)
    made |= temporal_columns(config.temporal, F.col(spec.date))
    source: dict[str, str] = {}
    for exog in config.exogenous:
        if exog.column not in present:
            warnings.warn(f"exogenous column '{exog.column}' not found, skipped", stacklevel=2)
            continue
        columns = exogenous_columns(exog)
        source |= dict.fromkeys(columns, exog.column)
        made |= columns
    helpers = [name for name in lags if name.startswith("_past_")]
    df = add_rolling(panel.on(add_lags(panel, lags)), rolling).withColumns({n: c for n, c in made.items() if c is not None}).drop(*helpers)
    names = list(made)
    for derived in config.derived:
        if not {derived.feature_a, derived.feature_b} <= set(df.columns):
            warnings.warn(f"derived feature '{derived.name}' lacks its inputs, skipped", stacklevel=2)
            continue
        df = df.withColumn(derived.name, derived_column(derived))
        names.append(derived.name)
    return Features(panel.on(df), list(dict.fromkeys(names)), source)


RESIDUAL = "target_residual"


def add_residual_target(features: Features, lag: int) -> Features:
    """Add the target minus its value ``lag`` rows back; that lag becomes a feature if it is not one yet."""
    name, panel = f"target_lag_{lag}", features.panel
    df = panel.df if name in panel.df.columns else add_lags(panel, {name: (panel.spec.target, lag)})
    names = features.names if name in panel.df.columns else [*features.names, name]
    df = df.withColumn(RESIDUAL, F.col(panel.spec.target) - F.col(name))
    return replace(features, panel=panel.on(df), names=names)


def training_features(panel: Panel, config: FeatureConfig, target_mode: str, residual_lag: int) -> tuple[Features, str]:
    """Features and the name of the column to fit. One pass over the ordered rows covers the residual lag too."""
    if target_mode == "raw":
        return build_features(panel, config), panel.spec.target
    if target_mode != "residual":
        raise ValueError(f"target_mode is 'raw' or 'residual', not {target_mode!r}")
    late = residual_lag not in config.target_lags
    lags = [*config.target_lags, residual_lag] if late else config.target_lags
    features = build_features(panel, replace(config, target_lags=lags))
    if late:
        # Added for the residual, so it stands after all configured features.
        name = f"target_lag_{residual_lag}"
        features = replace(features, names=[n for n in features.names if n != name] + [name])
    return add_residual_target(features, residual_lag), RESIDUAL


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or not a number."""
    held = []
    for name in columns:
        c = F.col(f"`{name}`")
        held.append(c.isNotNull() & ~F.isnan(c) if df.schema[name].dataType.typeName() in ("float", "double") else c.isNotNull())
    return df.filter(reduce(lambda a, b: a & b, held)) if held else df


def scaling(train: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of each feature over training rows; a deviation of 0 becomes 1."""
    return train.groupBy(*keys).agg(
        *[F.avg(F.col(f"`{name}`")).alias(f"_mean_{name}") for name in names],
        *[_deviation(name).alias(f"_std_{name}") for name in names],
    )


def _deviation(name: str) -> Column:
    std = F.stddev_pop(F.col(f"`{name}`"))
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def standardise(
    panel: Panel, df: DataFrame, constants: DataFrame, names: list[str], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Replace features of the panel's rows by their distance from the training mean in training deviations."""
    scaled = {name: (F.col(f"`{name}`") - F.col(f"`_mean_{name}`")) / F.col(f"`_std_{name}`") for name in names}
    return panel.attach_to(df, constants, keys).withColumns(scaled).select(*[F.col(f"`{name}`") for name in df.columns])
