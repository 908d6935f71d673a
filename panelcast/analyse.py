"""The profile of a raw table in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators.clean import clean_for_analysis
from .operators.profile import column_info, dataset_stats, default_split, normalised
from .plans.ordered import Panel
from .spec import SeriesSpec


@dataclass(frozen=True)
class Analysis:
    """Statistics per series, other columns, valued points with ISO dates, and default ranges. All lazy."""

    stats: DataFrame
    columns: DataFrame
    points: DataFrame
    ranges: DataFrame


def analyse(df: DataFrame, spec: SeriesSpec) -> Analysis:
    cleaned = clean_for_analysis(df, spec)
    return Analysis(
        stats=dataset_stats(Panel.of(cleaned, spec)),
        columns=column_info(cleaned, spec),
        points=normalised(cleaned, spec),
        ranges=default_split(cleaned, spec),
    )
