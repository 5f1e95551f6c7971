"""The training job: split, features, models, scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.sql import DataFrame

from lotwise.operators.evaluate import LEADERBOARD_DIGITS, fit_all, leaderboard
from lotwise.operators.features import FEATURES, FeatureSpec, feature_pipeline, split_train_test
from lotwise.operators.models import REGRESSORS
from lotwise.sources.workspace import materialize, scope


@dataclass(frozen=True)
class Training:
    """Fitted features and models with the scores of the test side."""

    features: PipelineModel
    models: dict[str, Model]
    board: DataFrame
    before: tuple[Transformer, ...] = ()

    def scorer(self, name: str) -> PipelineModel:
        """One of the models with its features and the stages before them, to be saved and loaded."""
        return PipelineModel([*self.before, *self.features.stages, self.models[name]])


def train_and_compare(
    df: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    names: Sequence[str] = tuple(REGRESSORS),
    share: float = 0.8,
    seed: int = 23,
    key: Sequence[str] = (),
    parallelism: int = 4,
    digits=LEADERBOARD_DIGITS,
    before: Sequence[Transformer] = (),
) -> Training:
    """Fit features on the train side, then every named model on its vectors.

    Train vectors are written once, in even files, as trees pass over them many
    times; the test side is read once, to score all models together. ``before``
    are fitted stages that ``df`` has been through, as ``Cleaned.grouper()``: a
    scorer takes raw values through them as well.
    """
    train, test = split_train_test(df, share, seed, key)
    features = feature_pipeline(train, spec)
    vectors = features.transform(train).select(FEATURES, spec.label)
    with scope(df.sparkSession):  # the vectors go when all models are fitted, or one of them fails
        train_vectors = materialize(vectors, "train", rebalance=True)
        models = fit_all({n: REGRESSORS[n](spec.label) for n in names}, train_vectors, parallelism)
    test_vectors = features.transform(test).select(FEATURES, spec.label)
    return Training(features, models, leaderboard(models, test_vectors, spec.label, digits), tuple(before))
