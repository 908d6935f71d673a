"""Text to number as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import once, stripped

# The characters a plain number has, and those of any number.
PLAIN_CHARACTERS = "0123456789.-"
NUMBER_CHARACTERS = PLAIN_CHARACTERS + "+eE"
# Fixed value: the least absolute denominator of ratios and relative changes.
MIN_DENOMINATOR = 1e-10


def number(c: Column) -> Column:
    """Text to double, null where it is not a number.

    Trimming by character set leaves nothing of a text that has only these characters; it costs far less
    than a pattern, and keeps out words and suffixes that a cast would read.
    """
    return F.when(F.btrim(c, F.lit(NUMBER_CHARACTERS)) == "", c.try_cast("double"))


def marked_number(c: Column) -> Column:
    """Text to double once a leading question mark and the first character that no number has are taken out."""

    def unmarked(text: Column) -> Column:
        return F.when(text.startswith("?"), F.substr(text, F.lit(2))).otherwise(text)

    def read(text: Column) -> Column:
        # What is left of the text from its first character that no plain number has.
        rest = F.ltrim(text, F.lit(PLAIN_CHARACTERS))
        whole = F.left(text, F.length(text) - F.length(rest))
        without = once(F.concat(whole, F.substr(rest, F.lit(2))), number)
        return F.when(rest == "", text.try_cast("double")).otherwise(without)

    return once(once(stripped(c), unmarked), read)


def over_magnitude(a: Column, b: Column) -> Column:
    """a / |b| with the denominator kept away from zero; null where b is null."""
    return F.when(b.isNotNull(), a / F.greatest(F.abs(b), F.lit(MIN_DENOMINATOR)))
