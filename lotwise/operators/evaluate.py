"""Regression scores from one pass over the predictions."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.columns import round_columns
from lotwise.operators.models import fit, predict

LEADERBOARD_DIGITS = {"R2": 2, "Mse": 4, "Mae": 4, "Rmse": 4}


def metric_mse(label: str = "price", prediction: str = "prediction") -> Column:
    error = F.col(label) - F.col(prediction)
    return F.avg(error * error)


def metric_rmse(label: str = "price", prediction: str = "prediction") -> Column:
    return F.sqrt(metric_mse(label, prediction))


def metric_mae(label: str = "price", prediction: str = "prediction") -> Column:
    return F.avg(F.abs(F.col(label) - F.col(prediction)))


def metric_r2(label: str = "price", prediction: str = "prediction") -> Column:
    """Share of the label's variance explained; null for a constant label."""
    spread = F.var_pop(F.col(label).cast("double"))
    return 1 - metric_mse(label, prediction) / F.nullif(spread, F.lit(0.0))


def _scores(label: str, prediction: str) -> list[Column]:
    return [
        metric_r2(label, prediction).alias("R2"),
        metric_mse(label, prediction).alias("Mse"),
        metric_mae(label, prediction).alias("Mae"),
        metric_rmse(label, prediction).alias("Rmse"),
    ]


def regression_metrics(
    df: DataFrame, label: str = "price", prediction: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """R2, Mse, Mae and Rmse of the predictions, per group if ``by`` is given."""
    return df.groupBy(*by).agg(*_scores(label, prediction))


def fit_all(estimators: Mapping[str, object], train: DataFrame, parallelism: int = 4) -> dict[str, Model]:
    """Fit several estimators on one frame, a few at a time.

    Each of them passes over ``train`` several times: give it a written table
    or a held frame. Trees keep their own binned copy while they are fitted.
    """
    with ThreadPoolExecutor(max(parallelism, 1)) as pool:
        # Each call takes its own copy of the thread's properties, which Spark changes while a query runs.
        runs = [inheritable_thread_target(train.sparkSession)(partial(fit, e, train)) for e in estimators.values()]
        return dict(zip(estimators, pool.map(lambda run: run(), runs)))


def leaderboard(
    models: Mapping[str, Model],
    test: DataFrame,
    label: str = "price",
    digits: Mapping[str, int] | None = LEADERBOARD_DIGITS,
) -> DataFrame:
    """One row of scores per model, all from a single pass over ``test``."""
    scored = test
    for i, model in enumerate(models.values()):
        scored = predict(model, scored, f"_prediction_{i}")
    measured = scored.agg(
        *[F.struct(*_scores(label, f"_prediction_{i}")).alias(f"_scores_{i}") for i in range(len(models))]
    )
    rows = [
        F.struct(F.lit(name).alias("Model"), *[F.col(f"_scores_{i}.{m}").alias(m) for m in LEADERBOARD_DIGITS])
        for i, name in enumerate(models)
    ]
    board = measured.select(F.inline(F.array(*rows)))
    return board if digits is None else round_columns(board, digits)
