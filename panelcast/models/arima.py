"""ARIMA(p, d, q) per series by regressions, after Hannan and Rissanen (1982).

A long autoregression gives residuals; the differenced target is then regressed on its own lags and
the residuals' lags. A third regression, on filtered values, takes one Gauss-Newton step from there. All are sums of
products per series. Estimates are consistent, though not those of an exact likelihood. A forecast h steps ahead is a power of a small matrix applied to the state at
the end of training, so every row is forecast by itself, in any partition.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.gram import DOUBLES, NOISY_FIT, dot, moments, row_moments, solve, solve_noise, summed_moments
from ..plans.lineage import cut
from ..plans.ordered import Panel, add_past, add_position
from ..spec import ModelSpec
from .base import Fitted, Ranges, as_forecast, fitted, kept, unfitted
from .bounds import around, interval_of
from .seasonal import Orders, solve_tied

#: Longest first-stage autoregression unless ``longest_ar`` says otherwise.
LONGEST_AR = 20
#: Numbers that the covariances of several steps ahead may hold at once.
HELD_NUMBERS = 4 << 20


def fit_arima(panel: Panel, ranges: Ranges, model: ModelSpec) -> Fitted:
    """Params: ``p``, ``d``, ``q`` (1 each), ``seasonal_order`` (none): (P, D, Q, period in rows), ``longest_ar`` (20): the most lags of the first regression, whose number
    grows with the logarithm of the series' length; ``stages`` (3; 2 leaves out the refinement of models with q > 0),
    ``interval`` (none): bounds from the variance of the noise to come. Seasonal models take two stages, whatever ``stages``;
    with Q > 0 the first regression is longer than the longest lag, so its matrix grows with the square of the period.

    Training rows of all ranges form one sequence in date order. Every prediction range starts at step 1
    after the end of training, whatever its dates. Series with too few training rows, or none that
    has all its lags, are left out and listed; if none is left, it is an error.
    """
    orders = Orders.of(model.params)
    p, d, q = orders.reach, orders.undone, orders.echo
    level, stages = interval_of(model), int(model.params.get("stages", 3))
    spec = replace(panel.spec, tiebreak=(*panel.spec.tiebreak, "range_id"))
    train = Panel.of(ranges.rows(panel, "train"), spec, panel.task_rows)
    message = f"Not enough training data for ARIMA{orders}"
    keys, y = spec.keys, F.col(spec.target)

    sizes = train.df.groupBy(*keys).agg(F.count(y).alias("_n"), F.avg(y).alias("_centre"))
    enough = sizes.filter(F.col("_n") >= p + d + q + 5)
    rows = train.attach(enough).filter(F.col("_n").isNotNull()).withColumn("_y", y - F.col("_centre"))
    train = train.on(rows.select(*keys, *spec.order, "_y", "_n", "_centre"))

    # One ordering pass gives the recent values of each row, and with them all lags of differences and residuals.
    most = int(model.params.get("longest_ar", LONGEST_AR))
    longest = max(p + q + 1, most) if q else 0
    recent = add_past(train, "_recent", "_y", max(p, longest + q) + d)
    levels = [F.col("_recent")]
    for lag in orders.steps:
        levels.append(_differences(levels[-1], lag))
    with kept(recent.withColumn("_w", levels[-1])) as frame:
        if q:
            frame = _with_residuals(train.on(frame), p, q, d, longest, most)
        lags = {f"_w_{i}": F.get("_w", F.lit(i)) for i in (0, *orders.ar_lags)}
        errors = {f"_e_{j}": F.get("_e", F.lit(j)) for j in orders.ma_lags}
        inputs = [*[f"_w_{i}" for i in orders.ar_lags], *errors]
        complete = frame.withColumns(lags | errors).dropna(subset=[*inputs, "_w_0"])
        sums = moments(complete, keys, [*inputs, "_w_0"]).filter(F.col("n") > 0)
        solved = solve_tied(orders, _stationary)("n", "mean", "products") if orders.seasonal else solve_noise("n", "mean", "products", F.lit(d == 0))
        fits = sums.withColumn("_fit", solved).select(*keys, "_fit.*")

        # The last training row holds the whole state: w and e with their lags, and the levels undone by differencing.
        # A seasonal fit has the differences in its coefficients, so its state is of values.
        values, slots, held = ("_recent", p + d, 0) if orders.seasonal else ("_w", p, d)
        ends = frame.groupBy(*keys).agg(
            F.max_by(
                F.struct(
                    F.array(*[_or_zero(values, i) for i in range(max(slots, 1))]).alias("w"),
                    F.array(*[_or_zero("_e", j) for j in range(q)]).cast("array<double>").alias("e"),
                    F.array(*[F.get(level, F.lit(0)) for level in levels[:held]]).cast("array<double>").alias("levels"),
                    F.col("_centre").alias("centre"),
                ),
                F.struct(*spec.order),
            ).alias("_end")
        )
        if q and stages > 2 and not orders.seasonal:
            fits = refined(train.on(frame), cut(fits), p, q, constant=d == 0)
            errors_now = F.coalesce("errors", "_end.e")
        else:
            errors_now = F.col("_end.e")
        state = F.concat("_end.w", errors_now, "_end.levels").alias("state")
        fits = train.attach_to(fits, ends).select(*keys, "coef", "intercept", "noise", state, "_end.centre")
        fits = fitted(fits.select(*keys, "centre", packed("coef", "intercept", "noise", "state").alias("_fit")), message)

    steps = replace(panel, series=panel.series * ranges.most, spec=replace(panel.spec, keys=(*keys, "range_id")))
    predict = add_position(steps.on(ranges.rows(panel, "predict")), "_step")
    scored = panel.attach_to(predict, fits).filter(F.col("_fit").isNotNull())
    scored = scored.withColumn("_ahead", forecasts(slots, held, q, level is not None, reflect=not orders.seasonal)(F.col("_fit"), F.col("_step")))
    skipped = unfitted(sizes, fits, keys, message) if keys else None
    value = F.col("_ahead.value") + F.col("centre")
    return Fitted(model, as_forecast(scored, panel, model, value, around(value, F.col("_ahead.deviation"), level)), skipped=skipped)


def _differences(values: Column, lag: int) -> Column:
    """Each value of a newest-first array minus the one ``lag`` before it in time."""
    n = F.greatest(F.size(values) - lag, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 1 + lag, n), lambda now, before: now - before)


def _or_zero(array: str, i: int) -> Column:
    return F.coalesce(F.get(array, F.lit(i)), F.lit(0.0))


def _with_residuals(train: Panel, p: int, q: int, d: int, longest: int, most: int) -> DataFrame:
    """Add ``_e``: this and q earlier residuals of an autoregression whose length grows with the series.

    A row's recent values reach far enough back for all of them, so no second ordering is needed.
    """
    keys = train.spec.keys
    grown = F.least(F.lit(most), F.round(10 * F.log10("_n")), F.floor(F.col("_n") / 4))
    length = F.greatest(F.lit(p + q + 1), grown).cast("int")
    # Lags beyond the series' own length are 0 and get no weight.
    past = F.concat(F.slice("_w", 2, length), F.array_repeat(F.lit(0.0), F.lit(longest) - length))
    full = train.df.filter(F.size("_w") > length)
    sums = row_moments(full, keys, F.concat(past, F.slice("_w", 1, 1)), longest + 1).filter(F.col("n") > 0)
    fits = cut(sums.withColumn("_ar", solve("n", "mean", "products", F.lit(d == 0))).select(*keys, "_ar"))

    def residual(j: int) -> Column:
        explained = dot(F.slice("_w", j + 2, length), F.slice("_ar.coef", 1, length))
        return F.when(F.size("_w") > length + j, F.get("_w", F.lit(j)) - F.col("_ar.intercept") - explained)

    return train.attach(fits).withColumn("_e", F.array(*[residual(j) for j in range(q + 1)])).drop("_ar")


def transition(coef: np.ndarray, constant: float, p: int, d: int, q: int, reflect: bool = True) -> np.ndarray:
    """One step of the state (w and lags, e and lags, levels, 1); ``reflect`` makes it stationary."""
    ar, ma = _stationary(coef[:p]) if reflect else coef[:p], coef[p:]
    slots = max(p, 1)
    size = slots + q + d + 1
    step = np.zeros((size, size))
    step[0, :p], step[0, slots : slots + q], step[0, -1] = ar, ma, constant
    step[1:slots, : slots - 1] = np.eye(slots - 1)
    if q > 1:
        step[slots + 1 : slots + q, slots : slots + q - 1] = np.eye(q - 1)
    # The highest difference moves by the new w, each lower one by the one above.
    moved = step[0].copy()
    for level in range(slots + q + d - 1, slots + q - 1, -1):
        step[level] = moved
        step[level, level] += 1.0
        moved = step[level].copy()
    step[-1, -1] = 1.0
    return step


def _stationary(ar: np.ndarray) -> np.ndarray:
    """Reflect explosive roots into the unit circle, as forecasts far ahead need."""
    if not len(ar):
        return ar
    roots = np.roots(np.concatenate([[1.0], -ar]))
    size = np.abs(roots)
    if (size < 1).all():
        return ar
    roots = np.where(size >= 1, roots / np.maximum(size, 1.001) ** 2, roots)
    return -np.real(np.poly(roots))[1:]


def powers_applied(step: np.ndarray, state: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``step`` to the power h applied to the state, for all h at once by repeated squaring."""
    out = np.tile(state, (len(h), 1))
    left = h.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = out[odd] @ step.T
        step, left = step @ step, left >> 1
    return out


def variances(step: np.ndarray, impulse: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Covariance of the state h steps ahead for noise of variance 1, for all h at once by doubling."""
    out = np.zeros((len(h), len(step), len(step)))
    block, left = np.outer(impulse, impulse), h.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = block + step @ out[odd] @ step.T
        block, step, left = block + step @ block @ step.T, step @ step, left >> 1
    return out


@F.pandas_udf(T.BinaryType())
def packed(coef: pd.Series, intercept: pd.Series, noise: pd.Series, state: pd.Series) -> pd.Series:
    """A fit as one value, so that rows of one fit are told apart by it at once."""
    rows = zip(intercept.astype(float), noise.astype(float), coef, state)
    return pd.Series([np.concatenate([[i, v], c, s]).astype("<f8").tobytes() for i, v, c, s in rows], dtype=object)


AHEAD = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("deviation", T.DoubleType())])


def forecasts(p: int, d: int, q: int, bounds: bool, reflect: bool = True):
    """(packed fit, steps ahead) -> value and standard deviation. Each distinct step of a fit is computed once per batch."""
    slots = max(p, 1)
    at = 0 if d == 0 else slots + q

    @F.arrow_udf(AHEAD)
    def ahead(fit: pa.Array, h: pa.Array) -> pa.Array:
        coded = fit.dictionary_encode()
        codes, steps = coded.indices.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        value, deviation = np.full(len(steps), np.nan), np.full(len(steps), np.nan)
        order = np.argsort(codes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
            numbers = np.frombuffer(coded.dictionary[int(codes[rows[0]])].as_py(), "<f8")
            step = transition(numbers[2 : 2 + p + q], numbers[0], p, d, q, reflect)
            each, back = np.unique(steps[rows], return_inverse=True)
            value[rows] = powers_applied(step, np.append(numbers[2 + p + q :], 1.0), each)[back, at]
            if bounds:
                impulse = np.zeros(len(step))
                impulse[0] = 1.0
                impulse[slots : slots + min(q, 1)] = 1.0
                impulse[slots + q : -1] = 1.0
                # Long states are taken a few steps ahead at a time.
                parts = np.array_split(each, -(-len(each) * len(step) ** 2 // HELD_NUMBERS))
                spread = np.concatenate([variances(step, impulse, part)[:, at, at] for part in parts])
                deviation[rows] = np.sqrt(spread[back] * numbers[1])
        columns = [pa.array(numbers, pa.float64(), from_pandas=True) for numbers in (value, deviation)]
        return pa.StructArray.from_arrays(columns, ["value", "deviation"])

    return ahead


# --- refinement of the moving average -----------------------------------------------------------


def refined(train: Panel, fits: DataFrame, p: int, q: int, constant: bool) -> DataFrame:
    """One Gauss-Newton step from two-stage estimates: coef, intercept, noise, and ``errors``, the last q residuals.

    Residuals follow from one another, e(t) = u(t) - theta e(t-1) - ..., as do their derivatives. A block of consecutive
    rows maps the state at its start to the state at its end by an affine map, so blocks are run from zero side by side, their
    maps are joined up in order, one small vector per block, and every block is run again from its true start. A series is one
    block while it fits a task. Steps that would leave the invertible region are not taken.
    """
    keys = train.spec.keys
    placed = add_position(train, "_at").filter(F.size("_w") > p)
    block = F.floor((F.col("_at") - 1) / train.task_rows).alias("_block")
    row = F.struct("_at", F.slice("_w", 1, p + 1).alias("w"))
    listed = placed.select(*keys, block, row.alias("_row")).groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    blocks = cut(listed.select(*keys, "_block", F.flatten(F.transform("_rows", lambda r: r["w"])).alias("_w")))
    known = train.attach_to(blocks, fits.select(*keys, "coef", "intercept"))

    ends = known.select(*keys, "_block", F.size("_w").alias("_cells"), "coef", _run(p, q)("_w", "coef", "intercept", F.lit(None).cast(DOUBLES)).alias("_run"))
    starts = _started(ends, keys, p, q)
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_block")]
    named = starts.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_block")], "_start")
    again = known.join(named, reduce(lambda a, b: a & b, match)).select(*known.columns, "_start")
    cells = again.select(*keys, _run(p, q)("_w", "coef", "intercept", "_start").alias("_run")).select(*keys, F.col("_run.cells").alias("cells"))
    sums = summed_moments(cells, keys, p + q + 1).filter(F.col("n") > 0)
    steps = sums.withColumn("_step", solve_noise("n", "mean", "products", F.lit(constant))).select(*keys, "_step")
    moved = train.attach_to(fits, steps).withColumn("_new", _stepped(p, q)("coef", "intercept", "noise", "_step"))
    final = cut(moved.select(*keys, "_new.*"))

    # The last residuals under the final coefficients: the blocks' maps once more.
    known = train.attach_to(blocks, final.select(*keys, "coef", "intercept"))
    ends = known.select(*keys, "_block", F.size("_w").alias("_cells"), "coef", _run(p, q)("_w", "coef", "intercept", F.lit(None).cast(DOUBLES)).alias("_run"))
    last = _started(ends, keys, p, q, ends=True)
    return train.attach_to(final, last.select(*keys, F.slice("_start", 1, q).alias("errors")))


RUN = T.StructType([T.StructField("end", DOUBLES), T.StructField("cells", DOUBLES)])


def companion(ma: np.ndarray) -> np.ndarray:
    """One step of the last q values of x(t) = -theta x(t-1) - ... without input."""
    step = np.zeros((len(ma), len(ma)))
    step[0] = -ma
    step[1:, :-1] = np.eye(len(ma) - 1)
    return step


def followed(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, intercept: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of (e, filtered w, filtered e) at every row of ``w`` (rows of w(t), w(t-1), ...), and the state at the end.

    The state holds the last q values of e, then max(p, q) of the filtered w, then q of the filtered e.
    """
    q, reach = len(ma), max(len(ar), len(ma))
    inputs = (w[:, 0] - intercept - w[:, 1:] @ ar).tolist()
    e, x, v = start[:q].tolist(), start[q : q + reach].tolist(), start[q + reach :].tolist()
    theta, out = ma.tolist(), []
    for u, now in zip(inputs, w[:, 0].tolist()):
        a = u - sum(map(mul, theta, e))
        b = now - sum(map(mul, theta, x))
        c = a - sum(map(mul, theta, v))
        e, x, v = [a, *e[:-1]], [b, *x[:-1]], [c, *v[:-1]]
        out.append((a, b, c))
    return np.array(out).reshape(-1, 3), np.array(e + x + v)


def _run(p: int, q: int):
    """(rows, coef, intercept, start) -> the state at the end; with a start also the sums of the step's regression."""
    reach = max(p, q)

    @F.pandas_udf(RUN)
    def run(w: pd.Series, coef: pd.Series, intercept: pd.Series, start: pd.Series) -> pd.DataFrame:
        rows = []
        for values, c, i, s in zip(w, coef, intercept, start):
            if c is None:
                rows.append((None, None))
                continue
            values, c = np.asarray(values).reshape(-1, p + 1), np.asarray(c)
            begin = np.zeros(2 * q + reach) if s is None else np.asarray(s)
            path, end = followed(values, c[:p], invertible(c[p:]), i, begin)
            cells = None
            if s is not None:
                # Values before the block's first row come from its start.
                x = np.concatenate([begin[q : q + reach][::-1], path[:, 1]])
                v = np.concatenate([begin[q + reach :][::-1], path[:, 2]])
                count = len(path)
                lagged = [x[reach - k : reach - k + count] for k in range(1, p + 1)] + [v[q - k : q - k + count] for k in range(1, q + 1)]
                z = np.column_stack([*lagged, path[:, 0]])
                cells = np.concatenate([[count], z.sum(axis=0), (z.T @ z)[np.triu_indices(z.shape[1])]])
            rows.append((end, cells))
        return pd.DataFrame(rows, columns=["end", "cells"])

    return run


def _started(runs: DataFrame, keys: tuple[str, ...], p: int, q: int, ends: bool = False) -> DataFrame:
    """(keys, block, start) of every block, or with ``ends`` (keys, start): the state after each series' last block."""
    reach = max(p, q)
    listed = runs.groupBy(*keys).agg(F.first("coef").alias("coef"), F.array_sort(F.collect_list(F.struct("_block", "_cells", F.col("_run.end").alias("end")))).alias("_parts"))

    @F.pandas_udf(T.ArrayType(DOUBLES))
    def joined(coef: pd.Series, sizes: pd.Series, offsets: pd.Series) -> pd.Series:
        out = []
        for c, cells, parts in zip(coef, sizes, offsets):
            if c is None:
                out.append([])
                continue
            step = companion(invertible(np.asarray(c)[p:]))
            wide = np.zeros((reach, reach))
            wide[0, :q] = step[0]
            wide[1:, :-1] = np.eye(reach - 1)
            state, states = np.zeros(2 * q + reach), []
            for size, part in zip(cells, parts):
                states.append(state)
                rows = int(size) // (p + 1)
                small, large = np.linalg.matrix_power(step, rows), np.linalg.matrix_power(wide, rows)
                e, x, v = state[:q], state[q : q + reach], state[q + reach :]
                # e drives its own filter, so the last part takes what e's start adds, run through without input.
                state = np.asarray(part) + np.concatenate([small @ e, large @ x, small @ v + _driven(step, e, rows)])
            states.append(state)
            out.append([states[-1]] if ends else states[:-1])
        return pd.Series(out, dtype=object)

    cells = F.transform("_parts", lambda part: part["_cells"])
    offsets = F.transform("_parts", lambda part: part["end"])
    states = listed.select(*keys, joined("coef", cells, offsets).alias("_states"), F.transform("_parts", lambda part: part["_block"]).alias("_blocks"))
    if ends:
        return states.select(*keys, F.get("_states", F.lit(0)).alias("_start"))
    paired = states.select(*keys, F.explode(F.arrays_zip("_blocks", "_states")).alias("_p"))
    return paired.select(*keys, F.col("_p._blocks").alias("_block"), F.col("_p._states").alias("_start"))


def _driven(step: np.ndarray, e: np.ndarray, rows: int) -> np.ndarray:
    """What ``rows`` steps of e from a start add to a filter of e that starts at zero: both by one power of a joint matrix."""
    q = len(step)
    joint = np.zeros((2 * q, 2 * q))
    joint[:q, :q] = joint[q:, q:] = step
    joint[q, :q] = step[0]
    return (np.linalg.matrix_power(joint, rows) @ np.concatenate([e, np.zeros(q)]))[q:]


def invertible(ma: np.ndarray) -> np.ndarray:
    """Reflect roots that residuals would explode by."""
    return -_stationary(-ma)


def _stepped(p: int, q: int):
    @F.pandas_udf(NOISY_FIT)
    def stepped(coef: pd.Series, intercept: pd.Series, noise: pd.Series, step: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c, i, v, delta, shift, left in zip(coef, intercept, noise, step["coef"], step["intercept"], step["noise"]):
            c = np.array(c, dtype=float)
            c[p:] = invertible(c[p:])
            new = c if delta is None else c + np.asarray(delta)
            if delta is None or not np.isfinite(new).all() or np.abs(np.roots(np.concatenate([[1.0], new[p:]]))).max(initial=0) >= 1:
                rows.append((c, i, v))
            else:
                rows.append((new, i + shift * (1 + c[p:].sum()), left))
        return pd.DataFrame(rows, columns=["coef", "intercept", "noise"])

    return stepped
