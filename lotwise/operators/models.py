"""Regressors with the settings the comparison uses."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import moments, slot_trees
from lotwise.operators.features import FEATURES
from lotwise.operators.levels import binary_slots
from lotwise.sources.workspace import shared_folder

SEED = 23
# The boosted-tree setting chosen after tuning.
TUNED = {"maxIter": 75, "maxDepth": 9, "stepSize": 0.06}


def _linear(features: str, label: str, **settings) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=label, **settings)


def linear(label: str = "price", features: str = FEATURES) -> LinearRegression:
    return _linear(features, label)


def ridge(label: str = "price", features: str = FEATURES) -> LinearRegression:
    return _linear(features, label, regParam=0.5, elasticNetParam=0.0)


def lasso(label: str = "price", features: str = FEATURES) -> LinearRegression:
    return _linear(features, label, regParam=0.1, elasticNetParam=1.0)


def decision_tree(label: str = "price", features: str = FEATURES, seed: int = SEED):
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, seed=seed)


def random_forest(label: str = "price", features: str = FEATURES, seed: int = SEED):
    return RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed)


def gbt(label: str = "price", features: str = FEATURES, seed: int = SEED, **settings) -> GBTRegressor:
    return GBTRegressor(featuresCol=features, labelCol=label, seed=seed, **settings)


def gbt_tuned(label: str = "price", features: str = FEATURES, seed: int = SEED) -> GBTRegressor:
    return gbt(label, features, seed, **TUNED)


# Rows of the comparison, by the name they are listed under.
REGRESSORS = {
    "Linear": linear,
    "RandomForest": random_forest,
    "DecisionTree": decision_tree,
    "Ridge": ridge,
    "Lasso": lasso,
    "GradientBoosting": gbt,
    "GradientBoosting(T)": gbt_tuned,
}


def fit(estimator, train: DataFrame) -> Model:
    """Fit on the two columns the estimator reads, so nothing else is carried.

    Trees on assembled vectors are grown from the slots that rows have. Spark's own
    take those that are not assembled; its boosting cuts its growing lineage in the shared
    folder every few trees. Least squares takes one pass, which adds up moments.
    """
    shared_folder(train.sparkSession)
    columns = (estimator.getFeaturesCol(), estimator.getLabelCol())
    rows = train.select(*columns)
    if slot_trees.supports(estimator, rows):
        return slot_trees.fit(estimator, rows)
    if isinstance(estimator, LinearRegression):
        few = moments.condensed(rows) if moments.supports(estimator) else None
        return estimator.fit(rows) if few is None else moments.fit(estimator, few)
    return _fit_folded(estimator, binary_slots(rows, columns[0]))


#: Different vectors up to which trees are fitted on one row for each.
FEW = 10_000


def _fit_folded(estimator, rows: DataFrame) -> Model:
    """Fit trees on one row for each vector, with its mean label and its count as weight, where there are few vectors.

    For a squared error the splits and leaves are the same: what varies among equal
    vectors no split can part. Samples of rows, and settings that count rows, need the rows.
    """
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    if isinstance(estimator, RandomForestRegressor) or not _squared(estimator):
        return estimator.fit(rows)
    key = vector_to_array(features)
    if rows.select(F.approx_count_distinct(F.xxhash64(key))).first()[0] > FEW:
        return estimator.fit(rows)
    value = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))  # as an error, which null is to Spark
    folded = rows.groupBy(key.alias("_key")).agg(
        F.first(features).alias(features), F.avg(value).alias(label), F.count(F.lit(1)).cast("double").alias("_rows")
    )
    kept = folded.select(F.col(features).alias(features, metadata=rows.schema[features].metadata), label, "_rows")
    model = estimator.copy({estimator.weightCol: "_rows"}).fit(kept)
    model.clear(model.weightCol)
    return model


def _squared(estimator) -> bool:
    """Whether every row counts once and only its squared error does."""
    plain = {"weightCol": None, "minWeightFractionPerNode": 0.0, "minInstancesPerNode": 1, "subsamplingRate": 1.0,
             "validationIndicatorCol": None, "lossType": "squared"}
    return all(estimator.getOrDefault(n) == v for n, v in plain.items() if estimator.hasParam(n) and estimator.isDefined(n))


def predict(model: Model, df: DataFrame, column: str = "prediction") -> DataFrame:
    """Add the model's prediction under ``column``."""
    return model.copy({model.predictionCol: column}).transform(df)


def prediction_sample(
    predictions: DataFrame,
    n: int = 20,
    order_by: tuple[str, ...] = (),
    features: str = FEATURES,
    label: str = "price",
    prediction: str = "prediction",
) -> DataFrame:
    """Features, label and prediction of ``n`` rows."""
    ordered = predictions.orderBy(*order_by) if order_by else predictions
    return ordered.select(features, label, prediction).limit(n)

