"""Tables from CSV, JSON and parquet files or records; forecasts to CSV."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import iso_text


#: Quotes within quoted fields are doubled, as RFC 4180 has it.
CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header row; blank lines are skipped. Without a schema one more pass finds the types.

    Found dates and timestamps stay text: their order of day and month is settled over all rows when
    cleaning, and they never pass through the session's time zone. A row with too few or too many fields,
    or with a value that is not of its column's type, is an error. ``multi_line`` allows line breaks in
    quoted fields; a file is then read by one task.
    """
    reader = spark.read.options(**CSV, mode="FAILFAST", multiLine=multi_line)
    if schema is None:
        found = reader.option("inferSchema", True).csv(path).schema
        texts = (T.DateType, T.TimestampType, T.TimestampNTZType)
        schema = T.StructType(
            [T.StructField(f.name, T.StringType() if isinstance(f.dataType, texts) else f.dataType) for f in found]
        )
    # Rows are checked whole, also where few of their columns are wanted.
    return reader.option("columnPruning", False).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON records, one per line; without a schema the types come from all records."""
    reader = spark.read.option("samplingRatio", 1.0)
    return (reader.schema(schema) if schema else reader).json(path)


def from_records(spark: SparkSession, records: list[dict[str, Any]]) -> DataFrame:
    """A small list of records given in the program, with the union of their fields."""
    names = list(dict.fromkeys(name for record in records for name in record))
    rows = [tuple(record.get(name) for name in names) for record in records]
    return spark.createDataFrame(rows, names, samplingRatio=1.0)


def with_date_cell(df: DataFrame, date: str) -> DataFrame:
    """Rows whose date cell is neither null nor blank."""
    c = F.col(date)
    if not isinstance(df.schema[date].dataType, T.StringType):
        return df.filter(c.isNotNull())
    return df.filter(c.isNotNull() & (F.trim(c) != ""))


def preview(df: DataFrame, order: tuple[str, ...], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def forecast_table(forecasts: DataFrame, models: list[tuple[str, str]], date: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per series and date, one column per model, and the actual of the first model that has the date.

    ``models`` lists (model_id, column name) in order; models that failed are left out by the caller. A
    model that has a date more than once (overlapping ranges) keeps its last range's prediction, while
    the actual keeps the first.
    """
    rank = F.lit(None).cast("int")
    for position, (model_id, _) in enumerate(models):
        rank = F.when(F.col("model_id") == model_id, position).otherwise(rank)
    ranked = forecasts.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    columns = [
        F.max_by(
            F.when(F.col("_rank") == position, F.col("prediction")),
            F.when(F.col("_rank") == position, F.col("range_id")),
        ).alias(name)
        for position, (_, name) in enumerate(models)
    ]
    actual = F.min_by("actual", F.struct("_rank", "range_id")).alias("actual")
    return ranked.groupBy(*keys, date).agg(actual, *columns)


def write_forecast_csv(table: DataFrame, path: str, date: str, keys: tuple[str, ...] = ()) -> None:
    """Write a forecast table sorted by series and date, dates as ISO text, one header per file."""
    ordered = table.orderBy(*keys, date).withColumn(date, iso_text(F.col(date)))
    ordered.write.mode("errorifexists").options(**CSV).csv(path)
