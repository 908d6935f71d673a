"""Queries over the supplied tables, each with SQL that gives the same rows where SQL can."""

from . import attributions, bounds, cleaning, evaluation, features, models, profiling, ranges, validation
from .registry import oracles, queries

__all__ = ["attributions", "bounds", "cleaning", "evaluation", "features", "models", "oracles", "profiling", "queries", "ranges", "validation"]
