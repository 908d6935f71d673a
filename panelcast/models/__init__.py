"""Forecasting models fitted and scored as Spark jobs."""
