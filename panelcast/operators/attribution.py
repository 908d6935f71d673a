"""How much each feature moved each prediction of a tree ensemble, and summaries of that."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import minute_of_day
from ..plans.lineage import new_path
from ..spec import FeatureConfig

# --- attribution per row ------------------------------------------------------------------------


class Leaf(NamedTuple):
    """A leaf with its path: the features tested, the interval each must lie in, the share of training rows passed."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def ensemble_leaves(model: GBTRegressionModel, df: DataFrame) -> tuple[list[Leaf], float]:
    """Leaves of all trees and the ensemble's mean output, from the saved model's node table.

    The table has at most trees x 2^(depth+1) rows: bounded by the parameters, not by the data.
    """
    spark = df.sparkSession
    path = new_path(spark, "trees")
    model.save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        node["prediction"].alias("prediction"),
        node["rawCount"].cast("double").alias("rows"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )
    leaves, base = [], 0.0
    for tree_id, tree in nodes.toPandas().groupby("treeID"):
        weight = float(model.treeWeights[int(tree_id)])
        by_id = tree.set_index("id")
        base += weight * by_id.at[0, "prediction"]
        leaves += _leaves(by_id, weight)
    return leaves, base


def _leaves(nodes: pd.DataFrame, weight: float) -> list[Leaf]:
    found, open_nodes = [], [(0, {})]
    while open_nodes:
        at, path = open_nodes.pop()
        node = nodes.loc[at]
        if node["left"] < 0:
            parts = np.array([path[f] for f in path], dtype=float).reshape(-1, 3)
            found.append(Leaf(weight * node["prediction"], np.array(list(path), dtype=int), *parts.T))
            continue
        feature = int(node["feature"])
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (int(node["left"]), (low, min(high, node["threshold"]))),
            (int(node["right"]), (max(low, node["threshold"]), high)),
        ):
            passed = share * nodes.at[child, "rows"] / node["rows"]
            open_nodes.append((child, {**path, feature: (*bounds, passed)}))
    return found


def leaf_attributions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf's path for each row, one column per feature on the path.

    A feature in a coalition passes the leaf or not; outside it, it passes with the share of training
    rows. Sums over coalitions of one size are coefficients of a product of linear terms. Rows that pass
    the same features share one computation.
    """
    depth = len(leaf.features)
    values = x[:, leaf.features]
    passes = (values > leaf.low) & (values <= leaf.high)
    patterns, which = np.unique(passes, axis=0, return_inverse=True)
    weights = np.array([factorial(s) * factorial(depth - 1 - s) / factorial(depth) for s in range(depth)])
    out = np.empty(patterns.shape)
    inside = patterns.astype(float)
    for i in range(depth):
        sums = np.zeros((len(patterns), depth))
        sums[:, 0] = 1.0
        for j in range(depth):
            if j != i:
                taken = sums[:, :-1] * inside[:, [j]]
                sums *= leaf.share[j]
                sums[:, 1:] += taken
        out[:, i] = leaf.value * (inside[:, i] - leaf.share[i]) * (sums @ weights)
    return out[which.reshape(-1)]


#: Features on a leaf's path up to which its contributions are tabulated, and bytes that all tables of an ensemble may take.
TABLE_BITS, TABLE_BYTES = 8, 128 << 20
#: Rows that go through all leaves together.
TOGETHER = 4096


def contributions(values: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with equally many features on their paths: (leaves, 2^features, features).

    The second axis is a code with one bit per feature, set where a row passes the leaf's interval. All leaves and codes take
    the steps of ``leaf_attributions`` together.
    """
    count, depth = share.shape
    inside = ((np.arange(1 << depth)[:, None] >> np.arange(depth)) & 1).astype(float)
    weights = np.array([factorial(s) * factorial(depth - 1 - s) / factorial(depth) for s in range(depth)])
    out = np.empty((count, 1 << depth, depth))
    for i in range(depth):
        sums = np.zeros((count, 1 << depth, depth))
        sums[:, :, 0] = 1.0
        for j in range(depth):
            if j != i:
                taken = sums[:, :, :-1] * inside[None, :, j, None]
                sums *= share[:, None, j, None]
                sums[:, :, 1:] += taken
        out[:, :, i] = values[:, None] * (inside[None, :, i] - share[:, i, None]) * (sums @ weights)
    return out


class Tables:
    """Leaves as look-ups: a row's value of each feature becomes a bin, bins give each leaf's code, the code its contributions."""

    def __init__(self, leaves: list[Leaf], width: int):
        self.cuts = [np.empty(0)] * width
        bounds: dict[int, set[float]] = {}
        for leaf in leaves:
            for feature, low, high in zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist()):
                bounds.setdefault(feature, set()).update((low, high))
        for feature, found in bounds.items():
            self.cuts[feature] = np.array(sorted(x for x in found if np.isfinite(x)))
        self.leaves, self.others, held = [], [], 0
        by_depth: dict[int, list[Leaf]] = {}
        for leaf in leaves:
            by_depth.setdefault(len(leaf.features), []).append(leaf)
        for depth in sorted(by_depth):
            size = (depth << depth) * 8
            room = max(0, (TABLE_BYTES - held) // size) if depth <= TABLE_BITS else 0
            tabled, rest = by_depth[depth][:room], by_depth[depth][room:]
            self.others += rest
            held += size * len(tabled)
            for start in range(0, len(tabled), 512):
                some = tabled[start : start + 512]
                made = contributions(np.array([leaf.value for leaf in some]), np.stack([leaf.share for leaf in some]))
                self.leaves += [(leaf.features.tolist(), self._bits(leaf), np.ascontiguousarray(table.T)) for leaf, table in zip(some, made)]

    def _bits(self, leaf: Leaf) -> list[np.ndarray]:
        """Per feature on the path and bin the leaf's bit of the code; the bin behind the last is that of no number."""
        out = []
        for place, (feature, low, high) in enumerate(zip(leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist())):
            cuts = self.cuts[feature]
            bins = np.arange(len(cuts) + 2)
            first = 0 if np.isneginf(low) else np.searchsorted(cuts, low) + 1
            last = len(cuts) if np.isposinf(high) else np.searchsorted(cuts, high)
            out.append(((bins >= first) & (bins <= last)).astype(np.uint8) << place)
        return out

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """One column per feature for the rows of ``x``."""
        phi = np.zeros((x.shape[1], len(x)))
        bins = [np.where(np.isnan(x[:, f]), len(cuts) + 1, np.searchsorted(cuts, x[:, f])) for f, cuts in enumerate(self.cuts)]
        for features, bits, table in self.leaves:
            code = bits[0][bins[features[0]]]
            for place in range(1, len(features)):
                code |= bits[place][bins[features[place]]]
            code = code.astype(np.intp)
            for place, feature in enumerate(features):
                phi[feature] += table[place][code]
        for leaf in self.others:
            phi[leaf.features] += leaf_attributions(leaf, x).T
        return phi.T


def tree_attributions(rows: DataFrame, model: GBTRegressionModel, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, one column per feature with its attribution, and ``base``.

    Base and attributions of a row sum to the model's prediction for it.
    """
    leaves, base = ensemble_leaves(model, rows)
    leaves = [leaf for leaf in leaves if len(leaf.features)]
    # Plain tuples, so that the broadcast needs no class of this package on the executors.
    shared = rows.sparkSession.sparkContext.broadcast([tuple(leaf) for leaf in leaves])
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("_phi", T.ArrayType(T.DoubleType()))])

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            x = np.column_stack([batch.column(f"_x_{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            phi = np.zeros(x.shape)
            if len(x):
                tables = tables or Tables([Leaf._make(leaf) for leaf in shared.value], len(names))
                for start in range(0, len(x), TOGETHER):
                    phi[start : start + TOGETHER] = tables.attributions(x[start : start + TOGETHER])
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(names)
            columns = [*[batch.column(k) for k in keep], pa.ListArray.from_arrays(offsets, phi.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_phi"])

    inputs = rows.select(*keep, *[F.col(f"`{name}`").cast("double").alias(f"_x_{i}") for i, name in enumerate(names)])
    wide = inputs.mapInArrow(attribute, schema)
    return wide.select(*keep, *[F.col("_phi")[i].alias(name) for i, name in enumerate(names)], F.lit(base).alias("base"))


# --- summaries ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """A cyclic calendar part: its flag, its two features, and its least and greatest value."""

    name: str
    features: tuple[str, str]
    first: int
    last: int

    def value(self, date: Column) -> Column:
        parts = {
            "hour_of_day": F.hour(date),
            "day_of_week": F.weekday(date),
            "month": F.month(date),
            "minute_of_day": minute_of_day(date),
        }
        return parts[self.name]


# Weekdays count from 0 = Monday here, months from 1.
GROUPS = (
    Group("hour_of_day", ("hour_sin", "hour_cos"), 0, 23),
    Group("day_of_week", ("dow_sin", "dow_cos"), 0, 6),
    Group("month", ("month_sin", "month_cos"), 1, 12),
    Group("minute_of_day", ("minute_of_day_sin", "minute_of_day_cos"), 0, 1439),
)
STRONG = 0.3


def used_groups(columns: list[str], config: FeatureConfig | None = None) -> list[Group]:
    """Groups whose two features are there and, given a configuration, switched on."""
    there = [g for g in GROUPS if set(g.features) <= set(columns)]
    return [g for g in there if config is None or getattr(config.temporal, g.name)]


def pair_sums(attributions: DataFrame, date: str, groups: list[Group]) -> DataFrame:
    """Per row and group: the calendar value and the sum of its sine's and cosine's attribution."""
    parts = [
        F.struct(
            F.lit(g.name).alias("group"),
            g.value(F.col(date)).cast("int").alias("value"),
            (F.col(g.features[0]) + F.col(g.features[1])).alias("shap"),
        )
        for g in groups
    ]
    return attributions.select(*[F.col(f"`{name}`") for name in attributions.columns], F.inline(F.array(*parts)))


def by_value(pairs: DataFrame) -> DataFrame:
    """Mean attribution and row count per group and calendar value."""
    return pairs.groupBy("group", "value").agg(F.avg("shap").alias("shap"), F.count(F.lit(1)).alias("count"))


def dense(values: DataFrame, groups: list[Group]) -> DataFrame:
    """Every value of each group's calendar, those never seen with 0."""
    calendars = F.array(*[F.struct(F.lit(g.name).alias("group"), F.sequence(F.lit(g.first), F.lit(g.last)).alias("v")) for g in groups])
    domain = values.sparkSession.range(1).select(F.inline(calendars)).select("group", F.explode("v").alias("value"))
    # One row per calendar value on both sides: fewer than 1,500.
    joined = domain.join(F.broadcast(values), ["group", "value"], "left")
    return joined.select(
        "group", "value", F.coalesce("shap", F.lit(0.0)).alias("shap"), F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def normalise(values: DataFrame) -> DataFrame:
    """Attribution relative to the largest absolute one of the group."""
    most = values.groupBy("group").agg(F.max(F.abs("shap")).alias("_most"))
    scale = F.when(F.col("_most") == 0, F.lit(1.0)).otherwise(F.col("_most"))
    # One row per group: four at most.
    return values.join(F.broadcast(most), "group").withColumn("shap_norm", F.col("shap") / scale).drop("_most")


def by_column(attributions: DataFrame, source: dict[str, str]) -> DataFrame:
    """Per exogenous column: mean absolute and mean attribution over rows and its features, and direction.

    ``source`` names the column each feature comes from. Derived features belong to none.
    """
    related: dict[str, list[str]] = {}
    for feature, column in source.items():
        related.setdefault(column, []).append(feature)
    means = []
    for column, features in related.items():
        rows = F.count(F.lit(1)) * len(features)
        total = reduce(lambda a, b: a + b, [F.sum(F.col(f"`{f}`")) for f in features])
        size = reduce(lambda a, b: a + b, [F.sum(F.abs(F.col(f"`{f}`"))) for f in features])
        means.append(
            F.struct(
                F.lit(column).alias("column"),
                F.try_divide(size, rows).alias("mean_abs_shap"),
                F.try_divide(total, rows).alias("mean_shap"),
                F.array(*map(F.lit, features)).alias("features"),
            )
        )
    listed = attributions.agg(F.array(*means).alias("m")).select(F.inline("m"))
    mean = F.col("mean_shap")
    direction = F.when(mean > 0, "positive").when(mean < 0, "negative").otherwise("neutral")
    return listed.select("column", "mean_abs_shap", "mean_shap", direction.alias("direction"), "features")


def strong_values(normalised: DataFrame) -> DataFrame:
    """Per group: how many calendar values push predictions up or down strongly."""
    return normalised.groupBy("group").agg(
        F.count_if(F.col("shap_norm") > STRONG).alias("positive"),
        F.count_if(F.col("shap_norm") < -STRONG).alias("negative"),
    )


def summarise_attributions(
    attributions: DataFrame, date: str, config: FeatureConfig, names: list[str], source: dict[str, str]
) -> dict[str, DataFrame]:
    """``rows``, and where the features allow, ``temporal`` (dense, normalised) and ``exogenous``."""
    tables = {"rows": attributions}
    if groups := used_groups(names, config):
        tables["temporal"] = normalise(dense(by_value(pair_sums(attributions, date, groups)), groups))
    if source:
        tables["exogenous"] = by_column(attributions, source)
    return tables
