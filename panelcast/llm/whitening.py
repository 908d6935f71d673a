"""Whitening of vectors: their leading principal components at unit variance, by Chebyshev-filtered subspace iteration.

Entries become integers, ``floor(scale * c) + shift``, so equal vectors are equal exactly and sums are exact. The fit list holds
each distinct vector once: a vector that was copied a million times counts like any other.

The covariance matrix is never formed. A pass over the fit list gives V·Q for a block Q of a few columns: every task centres
its vectors, as (n·x - S) / n with exact integers, before it multiplies, and sends one small sum. A polynomial of V applied
by the three-term recurrence of Chebyshev damps the part of the spectrum below the block's least Ritz value and lets the part
above grow; QR and a Rayleigh-Ritz step give new components. Those whose residual is down to rounding are set aside and the
rest goes on, until all that are wanted are certified by their residuals. What the driver holds has the size of the
block, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path

#: A component is certified when its residual is at most so many times the largest eigenvalue. Below that is rounding.
CERTIFIED, ROUNDING = 1e-11, 2e-15
#: Degree of the polynomial at most, and how much stronger it may lift the first column than the last.
DEGREE, LIFT = 16, 1e7
#: Rounds of filter and Rayleigh-Ritz before giving up with an error.
ROUNDS = 400
#: Columns of the block for each component wanted.
BLOCK = 3
#: Vectors handled together in a task.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct integer vectors with sums ``sums``; eigenvalues fall, components are columns."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n·x - S, exact: 64-bit integers where they surely suffice, Python's otherwise."""
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    most = max(int(np.abs(x).max(initial=0)), 1)
    if most * n < 1 << 61 and all(abs(int(s)) < 1 << 61 for s in sums):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _cells(make, size: int):
    """(cell, value) of the sum over a task's vectors of ``make(x)``, an array of fixed shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = make(_matrix(batch.column(0).slice(start, ROWS), size))
                total = part if total is None else total + part
        if total is not None:
            flat = np.ravel(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "value"])

    return run


def _summed(x: DataFrame, make, size: int, kind: str = "double") -> list:
    """The sum of ``make`` over all vectors, cell by cell. Tasks send sums; the driver gets one number per cell."""
    cells = x.mapInArrow(_cells(make, size), f"cell int, value {kind}")
    wide = F.col("value") if kind == "double" else F.col("value").cast("decimal(38,0)")
    return [row["value"] for row in cells.groupBy("cell").agg(F.sum(wide).alias("value")).orderBy("cell").collect()]


def rounded(vector, size, scale: int, shift: int):
    """floor(scale * c) + shift of every entry; entries a shorter vector lacks count as 0, scale * c beyond 2^62 as 2^62."""
    filled, most = F.concat(vector, F.array_repeat(F.lit(0.0), size - F.size(vector))), F.lit(2.0**62)
    return F.transform(filled, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), most), -most)) + F.lit(shift).cast("bigint"))


def usable(vector):
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def components(product, size: int, wanted: int, trace: float, seed: int = 20240611) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading eigenvalues and unit eigenvectors of a positive semidefinite matrix known by ``product(Q)`` = V·Q.

    Eigenvalues that are zero but for rounding have no component. Raises if a component can't be certified.
    """
    width, passes = min(size, BLOCK * wanted), 0
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    locked_values, locked = np.empty(0), np.empty((size, 0))
    best, stale = np.inf, 0

    def clear(columns: np.ndarray) -> np.ndarray:
        return columns - locked @ (locked.T @ columns)

    def beside(columns: np.ndarray) -> np.ndarray:
        """The product beside what is set aside, which would else grow out of its rounding errors."""
        return clear(product(clear(columns)))

    for _ in range(ROUNDS):
        image = product(block)
        passes += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - block * values, axis=0)
        top = max(values[0] if len(values) else 0.0, locked_values.max(initial=0.0))
        missing = min(wanted, size) - len(locked_values)
        # Values that vanish end the list: the rest of the spectrum lies below them.
        present = int((values[:missing] > max(top * size * 1e-14, 0.0)).sum()) if top > 0 else 0
        worst = residuals[:present].max(initial=0.0)
        stale = stale + 1 if worst > best / 2 else 0
        best = min(best, worst)
        done = worst <= ROUNDING * top or (stale >= 3 and worst <= CERTIFIED * top)
        if done:
            found = np.concatenate([locked_values, values[:present]])
            vectors = np.concatenate([locked, block[:, :present]], axis=1)
            order = np.argsort(-found, kind="stable")
            return found[order], vectors[:, order], passes
        # Components in front that are down to rounding are set aside; the block keeps clear of them from now on.
        ready = 0
        while ready < present - 1 and residuals[ready] <= ROUNDING * top and values[ready] - values[ready + 1] > 1e-6 * top:
            ready += 1
        if ready:
            locked_values, locked = np.concatenate([locked_values, values[:ready]]), np.concatenate([locked, block[:, :ready]], axis=1)
            block, image, values = block[:, ready:], image[:, ready:], values[ready:]
        block, spent = chebyshev(beside, block, image, values)
        passes += spent
        block = np.linalg.qr(clear(np.linalg.qr(clear(block))[0]))[0]
    raise ArithmeticError(f"No certificate after {ROUNDS} rounds: residual {worst:.3g} at a largest eigenvalue of {top:.3g}")


def chebyshev(product, block: np.ndarray, image: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
    """A polynomial of the matrix times the block, small on [0, least Ritz value] and growing above; and the passes it took."""
    half = values[-1] / 2
    if half <= values[0] * 1e-12:
        return image, 0
    reach = np.arccosh(max(values[0] / half - 1, 1 + 1e-12))
    degree = int(np.clip(np.log(LIFT) / reach, 1, DEGREE))
    first = sigma = half / (values[0] - half)
    now, before = (image - half * block) * (sigma / half), block
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        now, before = (product(now) - half * now) * (2 * following / half) - sigma * following * before, now
        sigma = following
    return now, degree - 1


def fit(vectors: DataFrame, size: int, wanted: int) -> Whitening:
    """Components of the distinct rows of ``vectors``, one column ``x`` of ``size`` integers each."""
    spark = vectors.sparkSession
    path = new_path(spark, "whitening")
    vectors.distinct().write.parquet(path)
    x = spark.read.parquet(path)

    def halves(part: np.ndarray) -> np.ndarray:
        """Rows, and sums of the upper and lower halves of the integers, which can't overflow."""
        return np.concatenate([[len(part)], (part >> 32).sum(axis=0), (part & 0xFFFFFFFF).sum(axis=0)])

    found = [int(value) for value in _summed(x, halves, size, "bigint")] if size else []
    if not found:
        return Whitening(0, np.zeros(size, object), 0.0, np.empty(0), np.empty((size, 0)), 0.0, 0)
    n, sums = found[0], np.array([(high << 32) + low for high, low in zip(found[1 : size + 1], found[size + 1 :], strict=True)], object)

    def centre(part: np.ndarray) -> np.ndarray:
        return centred(part, n, sums).astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        shape = block.shape

        def make(part: np.ndarray) -> np.ndarray:
            c = centre(part)
            return c.T @ (c @ block)

        return np.array(_summed(x, make, size)).reshape(shape) / n

    trace = float(_summed(x, lambda part: np.array([(centre(part) ** 2).sum()]), size)[0]) / n
    values, vectors_, passes = components(product, size, wanted, trace)
    error = 0.0
    if len(values):
        scaled = vectors_ / np.sqrt(values)

        def moments(part: np.ndarray) -> np.ndarray:
            w = centre(part) @ scaled
            return np.concatenate([w.sum(axis=0)[None], w.T @ w])

        found = np.array(_summed(x, moments, size)).reshape(len(values) + 1, len(values)) / n
        error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(len(values))).max())
    return Whitening(n, sums, trace, values, vectors_, error, passes)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per usable row of ``df`` and component.

    Rows whose vector is null or holds null or non-finite entries are left out; entries that a shorter vector lacks count
    as 0. Components are numbered from 1 by falling eigenvalue, at most ``wanted``; directions without variance have none, so a
    table of equal vectors, or an empty one, gives no rows. ``n`` is the number of distinct vectors and ``deviation`` the
    exact squared length of n·x - S, null where it exceeds a long. ``whitened`` is the coordinate over the component's standard
    deviation, ``explained`` the component's share of all variance, and ``identity_error`` the largest entry by which the covariance of
    the whitened fit list differs from the identity. Null and repeated keys are rows like others; other columns are not read.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    source = source.where(usable(F.col("vector")))
    size = source.agg(F.max(F.size("vector"))).first()[0] or 0
    x = rounded(F.col("vector"), F.lit(size), scale, shift).alias("x")
    model = fit(source.select(x), size, wanted)
    shared = df.sparkSession.sparkContext.broadcast(model)
    count = len(model.values)
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scaled = model.components / np.sqrt(model.values)
        explained = model.values / model.trace if model.trace else model.values
        for batch in batches if count else ():
            for start in range(0, batch.num_rows, ROWS):
                keys, rows = batch.column(0).slice(start, ROWS), _matrix(batch.column(1).slice(start, ROWS), size)
                apart = model.centred(rows)
                whitened = (apart.astype(np.float64) / model.n) @ scaled
                each, every = np.repeat(np.arange(len(rows)), count), np.tile(np.arange(count), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(each)),
                        pa.array((every + 1).astype(np.int32)),
                        pa.array(np.full(len(each), model.n, np.int64)),
                        deviations(apart).take(pa.array(each)),
                        pa.array(whitened.ravel()),
                        pa.array(explained[every]),
                        pa.array(np.full(len(each), model.identity_error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return source.select("key", x).mapInArrow(run, schema).withColumnRenamed("key", key)


def deviations(apart: np.ndarray) -> pa.Array:
    """Exact squared lengths of rows of integers; null beyond a long."""
    if apart.dtype != object:
        most = int(np.abs(apart).max(initial=0))
        if most * most * apart.shape[1] < 1 << 63:
            return pa.array((apart * apart).sum(axis=1))
        apart = apart.astype(object)
    totals = [sum(value * value for value in row) for row in apart.tolist()]
    return pa.array([total if total < 1 << 63 else None for total in totals], pa.int64())
