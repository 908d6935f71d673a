"""Joining small per-series results back to rows without letting a hot series sink one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A per-series table is broadcast up to this many rows. Above it the join shuffles, with salted keys.
BROADCAST_ROWS = 100_000
SALTS = 64


def attach(
    df: DataFrame, per_series: DataFrame, keys: tuple[str, ...], rows: int, salted: bool = True, null_keys: bool = True
) -> DataFrame:
    """Left join of a table with one row per series.

    ``rows`` is the known number of series and decides the join: broadcast while it is small, otherwise a
    shuffle. The shuffle is on the series and a salt taken from all columns of the row, so that the rows
    of one large series land in many tasks. Where no series is large the caller asks for no salt, and rows
    that already lie by series, as they do after lags, stay where they are. Null keys match each other.
    Without keys ``per_series`` has one row.
    """
    added = [name for name in per_series.columns if name not in keys]
    if not keys:
        one = per_series.select(F.struct(*[F.col(f"`{name}`") for name in added]).alias("_one"))
        return df.select("*", one.scalar().alias("_one")).select(
            *[F.col(f"`{name}`") for name in df.columns], *[F.col("_one")[n].alias(n) for n in added]
        )
    small = per_series.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"`{name}`") for name in added])
    # Null-safe equality hides that rows already lie by series, so it is used only where there are null keys.
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) if null_keys else F.col(k) == F.col(f"_k_{k}") for k in keys]
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), _all(match), "left").select(*[F.col(f"`{name}`") for name in [*df.columns, *added]])
    if not salted:
        return df.join(small, _all(match), "left").select(*[F.col(f"`{name}`") for name in [*df.columns, *added]])
    hashed = [F.col(f"`{field.name}`") for field in df.schema if not isinstance(field.dataType, T.MapType)]
    big = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    small = small.withColumn("_ksalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.join(small, _all([*match, F.col("_salt") == F.col("_ksalt")]), "left").select(*[F.col(f"`{name}`") for name in [*df.columns, *added]])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
