"""Train/test split and feature vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.columns import hash_text
from lotwise.operators.levels import LevelIndexer, SlotAssembler, SlotEncoder
from lotwise.sources.workspace import materialize

NUMERIC_VECTOR = "numerical_feature_vector"
SCALED_VECTOR = "scaled_numerical_feature_vector"
FEATURES = "final_feature_vector"


@dataclass(frozen=True)
class FeatureSpec:
    """Columns that become features, and the label."""

    numeric: tuple[str, ...] = ("odometer", "car_age")
    categorical: tuple[str, ...] = (
        "manufacturer", "model", "condition", "cylinders", "fuel", "title_status",
        "transmission", "drive", "type", "paint_color", "region",
    )
    label: str = "price"

    @property
    def index_columns(self) -> list[str]:
        return [f"{c}_index" for c in self.categorical]

    @property
    def one_hot_columns(self) -> list[str]:
        return [f"{c}_vector" for c in self.categorical]


def in_train(share: float, seed: int, key: Sequence[str]) -> Column:
    """True for a ``share`` of all keys, decided by a hash of the key."""
    bound = format(min(math.ceil(share * 2**32), 2**32 - 1), "08x")
    return F.substring(hash_text(seed, key), 1, 8) < F.lit(bound)


def split_train_test(
    df: DataFrame, share: float = 0.8, seed: int = 23, key: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint frames that make up ``df``, whatever its partitioning.

    Rows with equal keys fall on the same side. Without ``key`` the whole row is
    the key.
    """
    picked = in_train(share, seed, list(key or df.columns))
    return df.where(picked), df.where(~picked)


def written_split(
    df: DataFrame, share: float = 0.8, seed: int = 23, key: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``split_train_test``, written once: a side is read many times, and its rows are hashed once."""
    side = "_in_train"
    written = materialize(df.withColumn(side, in_train(share, seed, list(key or df.columns))), "sides")
    return written.where(F.col(side)).drop(side), written.where(~F.col(side)).drop(side)


def random_split(df: DataFrame, share: float = 0.8, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """Spark's own split; its sides change with the partitioning of ``df``."""
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test


def assemble_numeric(spec: FeatureSpec) -> VectorAssembler:
    """Numeric columns as one vector; a null value becomes NaN in it."""
    return VectorAssembler(
        inputCols=list(spec.numeric), outputCol=NUMERIC_VECTOR, handleInvalid="keep"
    )


def standard_scale() -> StandardScaler:
    """Subtract the mean and divide by the sample standard deviation."""
    return StandardScaler(
        inputCol=NUMERIC_VECTOR, outputCol=SCALED_VECTOR, withMean=True, withStd=True
    )


def string_index(spec: FeatureSpec) -> LevelIndexer:
    """Index by falling frequency, equal counts by value; unseen and null last."""
    return LevelIndexer(inputCols=list(spec.categorical), outputCols=spec.index_columns)


def one_hot(spec: FeatureSpec) -> SlotEncoder:
    """One slot per value seen in fitting; the unseen index is all zeros."""
    return SlotEncoder(inputCols=spec.index_columns, outputCols=spec.one_hot_columns)


def assemble_features(spec: FeatureSpec) -> SlotAssembler:
    """Scaled numbers and a slot for each level in one sparse vector, built from the indices."""
    scaled = {"numbers": SCALED_VECTOR, "width": len(spec.numeric)} if spec.numeric else {}
    return SlotAssembler(inputCols=spec.index_columns, outputCol=FEATURES, **scaled)


def feature_stages(spec: FeatureSpec) -> list[Estimator | Transformer]:
    """The stages in order; those for a kind of column the spec lacks are left out.

    The vector is built from the indices: one-hot vectors of single columns would
    only be joined end to end.
    """
    numeric = [assemble_numeric(spec), standard_scale()] if spec.numeric else []
    categorical = [string_index(spec)] if spec.categorical else []
    return [*numeric, *categorical, assemble_features(spec)]


def feature_pipeline(train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """All feature stages fitted on the train side only."""
    return Pipeline(stages=feature_stages(spec)).fit(train)
