"""Boosted regression trees on configured features, fitted over all series together."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attribution import summarise_attributions, tree_attributions
from ..operators.features import drop_incomplete, training_features
from ..plans.lineage import shared_dir
from ..plans.ordered import Panel, rows_per_task
from ..spec import FeatureConfig, ModelSpec
from .base import Fitted, Ranges, as_forecast, kept
from .bounds import interval_of, residual_quantiles

SEED = 42
#: Training rows of a task. A fit runs one job per tree and level, so tasks of few rows cost more than their work.
FIT_ROWS = 50_000


def fit_gbt(panel: Panel, ranges: Ranges, model: ModelSpec) -> Fitted:
    """Params: ``n_estimators`` (100), ``max_depth`` (6), ``learning_rate`` (0.1), ``feature_config`` or
    ``lags`` ([1, 7, 14, 30]), ``target_mode`` (raw or residual), ``residual_lag`` (1),
    ``max_bins`` (256): candidate split points per feature, ``interval`` (none): bounds from quantiles of the training residuals.

    Importances sum to 1. Attributions are those of the training rows.
    """
    params, spec = model.params, panel.spec
    config, level = FeatureConfig.from_params(params, [1, 7, 14, 30]), interval_of(model)
    mode, residual_lag = params.get("target_mode", "raw"), int(params.get("residual_lag", 1))
    features, target = training_features(panel, config, mode, residual_lag)
    names = features.names

    # Boosting passes over the training rows once per level and tree, so they are kept.
    complete = drop_incomplete(ranges.rows(features.panel, "train"), [*names, target])
    train = complete.select(*spec.keys, spec.date, target, *[F.col(f"`{name}`") for name in names])
    with kept(train) as rows:
        count = rows.count()
        if not count:
            raise ValueError("Not enough data after creating features")
        booster = boost(spread(rows, count, (*spec.keys, spec.date, target)), names, target, params)

    predict = drop_incomplete(ranges.rows(features.panel, "predict"), names)
    scored = booster.transform(_assemble(predict, names))
    prediction = F.col("prediction")
    if mode == "residual":
        prediction = prediction + F.col(f"target_lag_{residual_lag}")
    bounds = None
    if level is not None:
        residual = F.col(target) - F.col("prediction")
        scored = panel.attach_to(scored, residual_quantiles(booster.transform(_assemble(train, names)), residual, level), ())
        bounds = tuple(prediction + F.get("_bounds", F.lit(side)) for side in (0, 1))
    attributions = tree_attributions(train, booster, names, (*spec.keys, spec.date))
    return Fitted(
        model,
        as_forecast(scored, panel, model, prediction, bounds),
        importance=_importance(booster, model, names, panel.df),
        attribution=summarise_attributions(attributions, spec.date, config, names, features.source),
    )


def spread(rows: DataFrame, count: int, order: tuple[str, ...]) -> DataFrame:
    """The rows over as many tasks as their number asks for, in a fixed order, however many tasks made them."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows_per_task(spark)))
    columns = [F.col(f"`{name}`") for name in order]
    return rows.repartition(min(-(-count // FIT_ROWS), most), *columns).sortWithinPartitions(*columns)


def boost(train: DataFrame, names: list[str], target: str, params: dict) -> GBTRegressionModel:
    shared_dir(train.sparkSession)
    booster = GBTRegressor(
        featuresCol="_features",
        labelCol="_label",
        maxIter=int(params.get("n_estimators", 100)),
        maxDepth=int(params.get("max_depth", 6)),
        maxBins=int(params.get("max_bins", 256)),
        stepSize=float(params.get("learning_rate", 0.1)),
        lossType="squared",
        seed=SEED,
    )
    labelled = train.withColumn("_label", F.col(target).cast("double"))
    return booster.fit(_assemble(labelled, names).select("_features", "_label"))


def _assemble(df: DataFrame, names: list[str]) -> DataFrame:
    doubles = df.withColumns({f"_x_{i}": F.col(f"`{name}`").cast("double") for i, name in enumerate(names)})
    inputs = [f"_x_{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(doubles).drop(*inputs)


def _importance(booster: GBTRegressionModel, model: ModelSpec, names: list[str], df: DataFrame) -> DataFrame:
    sizes = booster.featureImportances.toArray()
    rows = [(model.id, at, name, float(sizes[at])) for at, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "model_id string, feature_pos int, feature string, importance double")
