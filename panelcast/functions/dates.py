"""Calendar parts and date parsing as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date formats tried for day-first text and for all other text, in order of preference.
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")
MONTH_FIRST_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "d/M/yyyy")
AUTO = "auto"

# Patterns of a year, a month and a day. Text is matched before it is converted, since a
# failed conversion costs far more than a failed match.
YEAR, MONTH, DAY = r"(\d{4})", r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
FORMAT_PATTERNS = {
    "d/M/yyyy": f"^{DAY}/{MONTH}/{YEAR}$",
    "d-M-yyyy": f"^{DAY}-{MONTH}-{YEAR}$",
    "d.M.yyyy": rf"^{DAY}\.{MONTH}\.{YEAR}$",
    "yyyy-M-d": f"^{YEAR}-{MONTH}-{DAY}$",
    "M/d/yyyy": f"^{MONTH}/{DAY}/{YEAR}$",
    "M-d-yyyy": f"^{MONTH}-{DAY}-{YEAR}$",
}
# What the automatic form reads, and how each text becomes ISO text.
AUTO_PATTERNS = (
    (f"^{YEAR}-{MONTH}-{DAY}" + r"($|[ T]\d{1,2}:.*$)", None),
    (f"^{YEAR}/{MONTH}/{DAY}" + r"($|[ T]\d{1,2}:.*$)", "$1-$2-$3$4"),
    (f"^{DAY}[/-]{MONTH}[/-]{YEAR}" + r"([ T]\d{1,2}:.*)$", "$3-$2-$1$4"),
)
BLANKS = " \t\n\r\f\v"


def moment(value: datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def stripped(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that it names several times, evaluated once per row also where it is not a plain column."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def parse_date(c: Column, fmt: str) -> Column:
    """Text to zone-free timestamp under one format, null where it does not match in full.

    Dates go through DATE, never through the session's time zone. The automatic form reads ISO text and,
    with a time of day, year-first or day-first text with slashes or dashes.
    """
    if fmt != AUTO:
        pattern = FORMAT_PATTERNS[fmt]
        return once(stripped(c), lambda text: F.when(text.rlike(pattern), F.try_to_date(text, fmt))).cast("timestamp_ntz")

    def read(text: Column) -> Column:
        iso = [(pattern, F.regexp_replace(text, pattern, form) if form else text) for pattern, form in AUTO_PATTERNS]
        return F.coalesce(*[F.when(text.rlike(pattern), t.try_cast("timestamp_ntz")) for pattern, t in iso])

    return once(stripped(c), read)


@dataclass(frozen=True)
class DateTokens:
    """A text column cut once into its separator and three numbers, from which every format is judged without another pattern.

    The columns are plain, not fields of a struct, so that the optimizer keeps them apart from their uses and computes them once.
    """

    prefix: str

    @classmethod
    def add(cls, df: DataFrame, c: Column) -> tuple[DataFrame, DateTokens]:
        """The frame with the text and its parts added, under names that it does not have."""
        prefix = "_date"
        while any(name.startswith(prefix) for name in df.columns):
            prefix += "_"
        made = cls(prefix)
        text, parts = made.text, F.col(f"{prefix}parts")
        # Only digits and separators are cut, so a part is a number or empty.
        plain = F.when(F.btrim(text, F.lit("0123456789/.-")) == "", F.split(F.translate(text, "/.", "--"), "-", 4))
        part, width, number = ([F.get(parts, F.lit(i)) for i in range(3)], *([F.col(f"{prefix}{name}{i}") for i in range(3)] for name in ("width", "number")))
        first, second = (F.substring(text, start, F.lit(1)) for start in (F.length(part[0]) + 1, F.length(part[0]) + F.length(part[1]) + 2))
        short, year = [w <= 2 for w in width], [w == 4 for w in width]
        flags = {
            "dMy": year[2] & short[0] & short[1] & _on_calendar(number[2], number[1], number[0]),
            "Mdy": year[2] & short[0] & short[1] & _on_calendar(number[2], number[0], number[1]),
            "yMd": year[0] & short[1] & short[2] & _on_calendar(number[0], number[1], number[2]),
        }
        cut = df.select("*", stripped(c).alias(f"{prefix}text")).select("*", plain.alias(f"{prefix}parts"))
        cut = cut.select(
            *[F.col(f"`{name}`") for name in df.columns],
            f"{prefix}text",
            F.when((F.size(parts) == 3) & (first == second), first).alias(f"{prefix}separator"),
            *[F.length(part[i]).alias(f"{prefix}width{i}") for i in range(3)],
            *[part[i].try_cast("int").alias(f"{prefix}number{i}") for i in range(3)],
        )
        return cut.select("*", *[F.coalesce(flag, F.lit(False)).alias(prefix + order) for order, flag in flags.items()]), made

    @property
    def text(self) -> Column:
        return F.col(f"{self.prefix}text")

    @property
    def separator(self) -> Column:
        return F.col(f"{self.prefix}separator")

    def number(self, i: int) -> Column:
        return F.col(f"{self.prefix}number{i}")

    def reads(self, fmt: str) -> Column:
        """Whether ``parse_date`` reads the text under the format; never null."""
        if fmt == AUTO:
            plain = F.col(f"{self.prefix}yMd") & F.coalesce(self.separator.isin("-", "/"), F.lit(False))
            return F.when(self.text.contains(":"), parse_date(self.text, AUTO).isNotNull()).otherwise(F.coalesce(plain, F.lit(False)))
        order, separator = "".join(part[0] for part in re.split(r"[/.-]", fmt)), re.search(r"[/.-]", fmt).group()
        return F.col(self.prefix + order) & F.coalesce(self.separator == separator, F.lit(False))


def _on_calendar(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= days)


def cycle(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part on a circle of the given period."""
    angle = 2 * F.pi() * part / period
    return F.sin(angle), F.cos(angle)


def iso_weekday(ts: Column) -> Column:
    """1 = Monday to 7 = Sunday, as the weekday features use it."""
    return F.weekday(ts) + 1


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def iso_text(ts: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    text = ts.cast("timestamp_ntz").cast("string")
    fraction = F.when(F.length(text) > 19, F.concat(F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))).otherwise("")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), fraction)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp, independent of the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), ts) * 1_000_000).cast("long")


def epoch_days(ts: Column) -> Column:
    return epoch_micros(ts) / F.lit(86_400_000_000)


def hour_start(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))
