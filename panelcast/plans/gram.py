"""Sums of products per fit, and least squares on them.

A fit over any number of rows needs only the row count, the means and the centred products of its
columns. Spark aggregates those; what is solved afterwards is one small matrix per fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
FIT = T.StructType([T.StructField("coef", DOUBLES), T.StructField("intercept", T.DoubleType())])
MOMENTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", DOUBLES), T.StructField("products", DOUBLES)])

# Up to this many columns the products are built-in aggregates; beyond, generated code grows too long
# and partial products are taken batch by batch.
BUILT_IN_COLUMNS = 12
# Groups of tasks whose matrices of one fit are added before the final sum.
SALTS = 64
# Bytes of partial matrices a task holds before it passes them on.
HELD_BYTES = 32 << 20
# Eigenvalues of the scaled matrix below this share of the largest count as zero.
RANK_TOLERANCE = 1e-12


def pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def moments(df: DataFrame, keys: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Per fit key: ``n``, ``mean`` (one per column) and ``products`` (centred, upper triangle by rows).

    Columns hold no nulls. Wide sets are summed around 0, so the caller brings them to a common scale
    first; narrow sets use the covariance aggregate, which is stable at any scale.
    """
    if len(columns) <= BUILT_IN_COLUMNS:
        c = [F.col(f"`{name}`").cast("double") for name in columns]
        n = F.count(F.lit(1))
        return df.groupBy(*keys).agg(
            n.alias("n"),
            F.array(*[F.avg(x) for x in c]).alias("mean"),
            F.array(*[F.covar_pop(c[i], c[j]) * n for i, j in pairs(len(c))]).alias("products"),
        )
    return row_moments(df, keys, F.array(*[F.col(f"`{name}`").cast("double") for name in columns]), len(columns))


def row_moments(df: DataFrame, keys: tuple[str, ...], row: Column, width: int) -> DataFrame:
    """As ``moments`` for columns given as one array of ``width`` doubles per row.

    Each task sums the products of its batches per fit, so what is shuffled is one small matrix per fit
    and task.
    """
    upper = np.triu_indices(width)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("cells", DOUBLES)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.RecordBatch, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            fits, cells = zip(*held.values())
            held.clear()
            columns = [pa.concat_arrays([fit.column(k) for fit in fits]) for k in keys]
            offsets = np.arange(len(cells) + 1, dtype=np.int32) * len(cells[0])
            columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(cells)))
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "cells"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = batch.column("_row").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for label, rows in _groups(batch.column("_fit")):
                part = z[rows]
                cells = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part)[upper]])
                fit, before = held.get(label, (None, 0.0))
                held[label] = (fit or batch.select(list(keys)).slice(rows[0], 1), before + cells)
                if len(held) * cells.nbytes > HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    label = F.to_json(F.struct(*keys)) if keys else F.lit("")
    return summed_moments(df.select(*keys, label.alias("_fit"), row.alias("_row")).mapInArrow(partial, schema), keys, width)


def summed_moments(cells: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """``moments`` from parts: ``cells`` of rows, sums and products (upper triangle) around 0.

    A fit with rows in every task has one matrix per task: they are added in two rounds, each over few.
    """
    salted = cells.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    halfway = salted.groupBy(*keys, "_salt").agg(_sum_of_arrays("cells").alias("cells"))
    summed = halfway.groupBy(*keys).agg(_sum_of_arrays("cells").alias("_s"))
    return summed.select(*keys, _centred("_s", F.lit(width)).alias("_m")).select(*keys, "_m.*")


@F.pandas_udf(MOMENTS)
def _centred(sums: pd.Series, width: pd.Series) -> pd.DataFrame:
    def one(s: np.ndarray, w: int) -> tuple:
        mean = s[1 : 1 + w] / s[0]
        return int(s[0]), mean, s[1 + w :] - s[0] * np.outer(mean, mean)[np.triu_indices(w)]

    # A global sum over no rows has no cells.
    none = (0, np.empty(0), np.empty(0))
    rows = [none if s is None else one(s, w) for s, w in zip(sums, width)]
    return pd.DataFrame(rows, columns=["n", "mean", "products"])


def _sum_of_arrays(name: str) -> Column:
    arrays = F.collect_list(name)
    rest = F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(arrays, F.lit(0)), lambda total, x: F.zip_with(total, x, lambda a, b: a + b))


def _groups(labels: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Row numbers of each label."""
    coded = labels.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    for rows in np.split(order, edges):
        yield coded.dictionary[int(codes[rows[0]])].as_py(), rows


def symmetric(products: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = products
    return full + np.triu(full, 1).T


def least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Coefficients from centred products; of all solutions the one of least norm.

    The rank is judged with every column scaled to length 1, so that columns of very different size do
    not look dependent.
    """
    length = np.sqrt(np.diag(gram))
    live = length > 0
    out = np.zeros(len(gram))
    if not live.any():
        return out
    length = length[live]
    values, vectors = np.linalg.eigh(gram[np.ix_(live, live)] / np.outer(length, length))
    kept = values > RANK_TOLERANCE * values[-1]
    root = np.sqrt(values[kept])
    half = (vectors[:, kept] * root).T * length
    right = (vectors[:, kept].T @ (cross[live] / length)) / root
    if kept.all():
        out[live] = (vectors @ (right / root)) / length
    else:
        out[live] = np.linalg.lstsq(half, right, rcond=None)[0]
    return out


def regressions(
    n: np.ndarray, mean: np.ndarray, products: np.ndarray, constant: bool
) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``moments``, the regression of the last column on the others, with or without a constant.

    Fits of full rank are solved together; ``least_squares`` takes the others one by one.
    """
    width = mean.shape[1]
    g = np.zeros((len(n), width, width))
    rows, columns = np.triu_indices(width)
    g[:, rows, columns] = g[:, columns, rows] = products
    if not constant:
        g += n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    gram, cross = g[:, :-1, :-1], g[:, :-1, -1]
    coef = np.zeros(cross.shape)
    if width > 1:
        length = np.sqrt(np.einsum("bii->bi", gram))
        unit = np.where(length > 0, length, 1.0)
        values, vectors = np.linalg.eigh(gram / (unit[:, :, None] * unit[:, None, :]))
        full = (length > 0).all(axis=1) & (values[:, 0] > RANK_TOLERANCE * values[:, -1])
        along = np.einsum("bij,bi->bj", vectors, cross / unit) / np.where(values != 0, values, 1.0)
        coef = np.einsum("bij,bj->bi", vectors, along) / unit
        for i in np.flatnonzero(~full):
            coef[i] = least_squares(gram[i], cross[i])
    intercept = mean[:, -1] - (coef * mean[:, :-1]).sum(axis=1) if constant else np.zeros(len(n))
    return coef, intercept


@F.pandas_udf(FIT)
def solve(n: pd.Series, mean: pd.Series, products: pd.Series, constant: pd.Series) -> pd.DataFrame:
    """``regressions`` on the rows of ``moments``."""
    if n.empty:
        return pd.DataFrame({"coef": [], "intercept": []})
    coef, intercept = regressions(n.to_numpy(), np.stack(mean), np.stack(products), bool(constant.iloc[0]))
    return pd.DataFrame({"coef": list(coef), "intercept": intercept})


@F.pandas_udf(FIT)
def solve_scaled(n: pd.Series, mean: pd.Series, products: pd.Series, scale: pd.Series, centre: pd.Series) -> pd.DataFrame:
    """As ``solve`` with a constant, for columns that were summed as (value - centre) / scale: coefficients are for the values."""
    if n.empty:
        return pd.DataFrame({"coef": [], "intercept": []})
    size = np.stack(scale)
    i, j = np.triu_indices(size.shape[1])
    raw = np.stack(products) * size[:, i] * size[:, j]
    coef, intercept = regressions(n.to_numpy(), np.stack(mean) * size + np.stack(centre), raw, True)
    return pd.DataFrame({"coef": list(coef), "intercept": intercept})


NOISY_FIT = T.StructType([*FIT.fields, T.StructField("noise", T.DoubleType())])


@F.pandas_udf(NOISY_FIT)
def solve_noise(n: pd.Series, mean: pd.Series, products: pd.Series, constant: pd.Series) -> pd.DataFrame:
    """As ``solve``, with the variance of what is left, null where nothing is left to judge it by."""
    if n.empty:
        return pd.DataFrame({"coef": [], "intercept": [], "noise": []})
    constant = bool(constant.iloc[0])
    counts, means, rows = n.to_numpy(), np.stack(mean), np.stack(products)
    coef, intercept = regressions(counts, means, rows, constant)
    noise = []
    for count, m, cells, c in zip(counts, means, rows, coef):
        g = symmetric(cells, len(m)) + (0 if constant else count * np.outer(m, m))
        free = count - len(c) - constant
        left = g[-1, -1] - 2 * c @ g[:-1, -1] + c @ g[:-1, :-1] @ c
        noise.append(max(left, 0.0) / free if free > 0 else None)
    return pd.DataFrame({"coef": list(coef), "intercept": intercept, "noise": noise})


def dot(row: Column, coef: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(row, coef, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
