"""Least squares from moments: a few weighted rows that stand for all.

A linear model with a squared error depends on its rows by their number, means and
covariances alone. One pass adds those up, and Spark's regression is fitted on twice as many
weighted rows as there are features, which have the same: so any number of
penalties takes one pass over the rows. What leaves a task is a square of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.slot_trees import _flat
from lotwise.sources.workspace import new_path, scope

#: Features beyond which the square is too large to add up, and Spark's regression takes the rows.
MOST = 2048
#: Features up to which rows are multiplied as dense lines, which is faster than pair by pair.
DENSE = 512
#: Numbers or pairs of entries that a task holds at once.
PAIRS = 1 << 21
#: Share of a second moment below which a variance is mostly rounding.
ROUNDING = 1e-10
WEIGHT = "_rows"


def _size(rows: DataFrame) -> int | None:
    first = rows.select(rows.columns[0]).first()
    return None if first is None or first[0] is None else int(first[0].size)


def supports(estimator) -> bool:
    """Whether Spark itself would solve by moments, with every row counted once."""
    return (
        type(estimator) is LinearRegression
        and estimator.getLoss() == "squaredError"
        and estimator.getSolver() in ("auto", "normal")
        and not (estimator.isDefined(estimator.weightCol) and estimator.getWeightCol())
    )


def second_moments(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of the products of all pairs of 1, the features and the label; NaN where a row lacks either."""
    width = size + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * width)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if batch.column(0).null_count or batch.column(1).null_count:
                sums[:] = np.nan
                continue
            of, at, value = _flat(batch)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            if size <= DENSE:
                step = max(PAIRS // width, 1)
                for first in range(0, n, step):
                    here = slice(*np.searchsorted(of, [first, first + step]))
                    lines = np.zeros((min(step, n - first), width))
                    lines[:, 0], lines[:, -1] = 1.0, label[first : first + step]
                    lines[of[here] - first, at[here] + 1] = value[here]
                    sums += (lines.T @ lines).ravel()
                continue
            # Entries of a row side by side: 1, its features, its label.
            of = np.concatenate([np.arange(n), of, np.arange(n)])
            order = np.argsort(of, kind="stable")
            at = np.concatenate([np.zeros(n, np.int64), at + 1, np.full(n, width - 1)])[order]
            value = np.concatenate([np.ones(n), value, label])[order]
            count = np.bincount(of, minlength=n)
            start, pairs = np.cumsum(count) - count, np.cumsum(count * count)
            first = 0
            while first < n:
                before = pairs[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(pairs, before + PAIRS, side="right")))
                c = count[first:stop]
                # Each entry with all entries of its row.
                left = np.repeat(np.arange(start[first], start[first] + c.sum()), np.repeat(c, c))
                ends = np.cumsum(np.repeat(c, c))
                right = np.arange(len(left)) - np.repeat(ends - np.repeat(c, c), np.repeat(c, c)) + np.repeat(np.repeat(start[first:stop], c), np.repeat(c, c))
                sums += np.bincount(at[left] * width + at[right], weights=value[left] * value[right], minlength=width * width)
                first = stop
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    added = rows.mapInArrow(add, "sums binary").rdd.map(lambda row: np.frombuffer(row["sums"]))
    return added.treeReduce(np.add).reshape(width, width)


def _points(sums: np.ndarray) -> np.ndarray | None:
    """Points (features and label) of equal weight with the means and covariances of the sums; None where those are mostly rounding."""
    n, mean, square = sums[0, 0], sums[0, 1:] / sums[0, 0], np.diag(sums)[1:] / sums[0, 0]
    covariance = sums[1:, 1:] / n - np.outer(mean, mean)
    variance = np.diag(covariance)
    fixed = (variance == 0) & np.isin(mean, (0.0, 1.0))
    if fixed[-1] or (~fixed & (variance <= ROUNDING * square)).any():
        return None
    spread = np.sqrt(np.where(fixed, 1.0, variance))
    values, axes = np.linalg.eigh(covariance / np.outer(spread, spread))
    # On both sides of the mean along each axis.
    steps = (axes * np.sqrt(np.maximum(values, 0.0) * len(values)) * np.where(fixed, 0.0, spread)[:, None]).T
    return np.concatenate([mean + steps, mean - steps])


def condensed(rows: DataFrame) -> DataFrame | None:
    """Weighted rows that stand for ``rows`` of features and label; None where they cannot.

    A row without a label or vector, or with one that is no number, is left to Spark, which refuses it, and so is a constant label.
    """
    features, label = rows.columns
    size = _size(rows)
    if size is None or size > MOST:
        return None
    sums = second_moments(rows.select(features, F.col(label).cast("double")), size)
    if not np.isfinite(sums).all():
        return None
    points = _points(sums)
    if points is None:
        return None
    weight = float(sums[0, 0] / len(points))
    found = rows.sparkSession.createDataFrame([(p[:-1].tolist(), float(p[-1]), weight) for p in points], "x array<double>, y double, w double")
    return found.select(array_to_vector("x").alias(features), F.col("y").alias(label), F.col("w").alias(WEIGHT))


def fit(estimator: LinearRegression, few: DataFrame) -> LinearRegressionModel:
    """The model on condensed rows, without a summary, which would count those."""
    model = estimator.copy({estimator.weightCol: WEIGHT}).fit(few)
    model.clear(model.weightCol)
    with scope(few.sparkSession):
        path = new_path(few.sparkSession, "linear")
        model.write().save(path)
        return LinearRegressionModel.load(path)
