"""Typed, ordered, null-free panels from raw tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import AUTO, DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS, DateTokens, parse_date, stripped
from ..functions.numbers import marked_number, number
from ..spec import SeriesSpec

FORMATS = tuple(dict.fromkeys((*DAY_FIRST_FORMATS, *MONTH_FIRST_FORMATS, AUTO)))


def type_label(data_type: T.DataType) -> str:
    """numeric, boolean, date or string."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string"


# --- column roles -------------------------------------------------------------------------------


def role_profile(df: DataFrame) -> DataFrame:
    """Per column: its position, whether its name hints at a date, and how many rows read as date or number.

    One aggregate over the whole table.
    """
    counts = []
    for position, name in enumerate(df.columns):
        c, label = F.col(f"`{name}`"), type_label(df.schema[name].dataType)
        text = stripped(c)
        if label == "date":
            dates, numbers = F.count(c), F.lit(0)
        elif label == "numeric":
            dates, numbers = F.lit(0), F.count(c)
        elif isinstance(df.schema[name].dataType, T.StringType):
            dates = F.count(F.coalesce(*[parse_date(c, fmt) for fmt in FORMATS]))
            numbers = F.count(number(text))
        else:
            dates, numbers = F.lit(0), F.lit(0)
        hint = re.search("date|time", name.lower()) is not None
        counts.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(position).alias("position"),
                F.lit(hint).alias("name_hint"),
                F.count(c).alias("filled"),
                dates.cast("long").alias("as_date"),
                numbers.cast("long").alias("as_number"),
            )
        )
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def guess_roles(df: DataFrame) -> tuple[str, str]:
    """The likely date and target columns.

    Date: the first column whose name hints at one, else the first in which most filled rows read as a
    date, else the first. Target: the first other column in which most filled rows are numbers, else the
    second column.
    """
    profile = sorted(role_profile(df).collect(), key=lambda row: row["position"])
    mostly = lambda row, kind: row["filled"] > 0 and 2 * row[kind] > row["filled"]
    date = next(
        (row["name"] for row in profile if row["name_hint"]),
        next((row["name"] for row in profile if mostly(row, "as_date")), df.columns[0]),
    )
    second = df.columns[min(1, len(df.columns) - 1)]
    return date, next((row["name"] for row in profile if row["name"] != date and mostly(row, "as_number")), second)


# --- dates --------------------------------------------------------------------------------------


def date_parts(c: Column) -> tuple[Column, Column]:
    """The first two whole numbers of a date text split at its first kind of separator.

    The second counts only where the first is a number too.
    """
    text = stripped(c)
    parts = F.when(text.contains("/"), F.split(text, "/")).when(text.contains("-"), F.split(text, "-"))
    parts = parts.when(text.contains("."), F.split(text, r"\."))
    first = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    return first, F.when(first.isNotNull(), F.trim(F.get(parts, F.lit(1))).try_cast("int"))


def token_parts(tokens: DateTokens) -> tuple[Column, Column]:
    """``date_parts`` of a text that is cut already; only texts of another shape are split again."""
    plain = tokens.separator.isNotNull()
    first, second = date_parts(tokens.text)
    number = tokens.number(0)
    return F.when(plain, number).otherwise(first), F.when(plain, F.when(number.isNotNull(), tokens.number(1))).otherwise(second)


def date_order(max_first: Column, max_second: Column) -> Column:
    """DMY or MDY from the greatest first and second parts, null when nothing could be read."""
    unread = max_first.isNull() | max_second.isNull()
    return F.when(unread, None).when(max_first > 12, "DMY").otherwise("MDY")


def format_counts(df: DataFrame, date: str) -> DataFrame:
    """One row: the day/month order of a text column and how many rows each format reads."""
    cut, tokens = DateTokens.add(df.select(F.col(f"`{date}`").alias("d")), F.col("d"))
    first, second = token_parts(tokens)
    return cut.agg(
        date_order(F.max(first), F.max(second)).alias("order"),
        *[F.count_if(tokens.reads(fmt)).alias(fmt) for fmt in FORMATS],
    )


def best_format(order: str | None, counts: dict[str, int], date: str) -> str:
    """The format that reads most rows. Earlier formats win ties, the automatic form must read more."""
    candidates = (*(DAY_FIRST_FORMATS if order == "DMY" else MONTH_FIRST_FORMATS), AUTO)
    best = max(candidates, key=lambda fmt: counts[fmt])
    if counts[best] == 0:
        raise ValueError(f"Could not parse date column '{date}'")
    return best


# --- target and other columns -------------------------------------------------------------------


def coerce_columns(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Every other column as a number: booleans as 0 and 1, text read as number or null."""
    out = []
    for name in df.columns:
        c, data_type = F.col(f"`{name}`"), df.schema[name].dataType
        if name in keep or isinstance(data_type, (T.NumericType, T.ArrayType, T.MapType, T.StructType)):
            out.append(c)
        elif isinstance(data_type, T.BooleanType):
            out.append(c.cast("double").alias(name))
        else:
            out.append(number(stripped(c)).alias(name))
    return df.select(*out)


@dataclass(frozen=True)
class Cleaning:
    """How one raw table is read: decided by one aggregate over all its rows."""

    date_format: str | None
    date_order: str | None
    strip_target: bool
    dated_rows: int
    valid_rows: int


def plan_cleaning(df: DataFrame, spec: SeriesSpec) -> Cleaning:
    """Choose the date format, and whether target text is cleaned or, if any text still fails, only cast.

    All counts come from one pass; the counts on the target are taken under every date format, since the
    format is not known before the pass ends.
    """
    date_is_text = type_label(df.schema[spec.date].dataType) != "date"
    date, target = F.col(spec.date), F.col(spec.target)
    text_target = not isinstance(df.schema[spec.target].dataType, T.NumericType)
    cleaned, plain = _target(target, text_target), _plain(target, text_target)

    # Each text is cut once per row, and from its parts come the flags; the aggregate then only counts.
    formats = FORMATS if date_is_text else ("typed",)
    there = target.isNotNull() if text_target else F.lit(False)
    flags = df.select(date.alias("_d"), there.alias("_there"), cleaned.isNotNull().alias("_cleaned"), plain.isNotNull().alias("_plain"))
    if date_is_text:
        flags, tokens = DateTokens.add(flags, F.col("_d"))
        (first, second), read = token_parts(tokens), [tokens.reads(fmt) for fmt in formats]
    else:
        first, second, read = F.lit(None), F.lit(None), [F.col("_d").isNotNull()]
    flags = flags.select(
        first.cast("int").alias("_first"),
        second.cast("int").alias("_second"),
        (F.col("_there") & ~F.col("_cleaned")).alias("_failed"),
        "_cleaned",
        "_plain",
        *[flag.alias(fmt) for flag, fmt in zip(read, formats)],
    )
    counts = [
        F.struct(
            F.count_if(F.col(f"`{fmt}`")).alias("dated"),
            F.count_if(F.col(f"`{fmt}`") & F.col("_failed")).alias("failed"),
            F.count_if(F.col(f"`{fmt}`") & F.col("_cleaned")).alias("cleaned"),
            F.count_if(F.col(f"`{fmt}`") & F.col("_plain")).alias("plain"),
        ).alias(fmt)
        for fmt in formats
    ]
    row = flags.agg(date_order(F.max("_first"), F.max("_second")).alias("order"), *counts).first()
    fmt = best_format(row["order"], {f: row[f]["dated"] for f in FORMATS}, spec.date) if date_is_text else None
    counts = row[fmt or "typed"]
    strip = text_target and counts["failed"] == 0
    return Cleaning(fmt, row["order"], strip, counts["dated"], counts["cleaned"] if strip else counts["plain"])


def _target(c: Column, text: bool) -> Column:
    return marked_number(c) if text else c.cast("double")


def _plain(c: Column, text: bool) -> Column:
    return number(c.cast("string")) if text else c.cast("double")


def apply_cleaning(df: DataFrame, spec: SeriesSpec, cleaning: Cleaning, drop_null_target: bool = True) -> DataFrame:
    """Typed dates and target; rows without a date go, and rows without a target unless kept. No job."""
    text_target = not isinstance(df.schema[spec.target].dataType, T.NumericType)
    date, target = F.col(spec.date), F.col(spec.target)
    ds = parse_date(date, cleaning.date_format) if cleaning.date_format else date.cast("timestamp_ntz")
    y = _target(target, text_target) if cleaning.strip_target else _plain(target, text_target)
    out = df.withColumns({spec.date: ds, spec.target: y}).filter(F.col(spec.date).isNotNull())
    return out.filter(F.col(spec.target).isNotNull()) if drop_null_target else out


def clean_for_analysis(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with a date; the target may be null and other columns stay as they are."""
    cleaning = plan_cleaning(df, spec)
    if cleaning.dated_rows == 0:
        raise ValueError("No valid data after parsing")
    return apply_cleaning(df, spec, cleaning, drop_null_target=False)


def clean_for_training(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with a date and a target, every other column numeric."""
    cleaning = plan_cleaning(df, spec)
    if cleaning.valid_rows == 0:
        raise ValueError("No valid data rows after cleaning")
    return coerce_columns(apply_cleaning(df, spec, cleaning), spec.reserved)
