"""Least squares from moments equals Spark's own on the rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lotwise.operators import models as M
from lotwise.operators import moments
from lotwise.operators import tune as T


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, a, b = rng.normal(size=2), int(rng.integers(3)), int(rng.integers(5))
        slots = {0: float(x[0]), 1: float(x[1]), 2 + a: 1.0, **({5 + b: 1.0} if b < 4 else {}), 9: 1.0}
        vector = Vectors.sparse(10, slots) if i % 3 else Vectors.dense([slots.get(j, 0.0) for j in range(10)])
        rows.append((vector, float(1000 + 300 * x[0] - 90 * x[1] + 50 * a * a - 20 * b + rng.normal())))
    return spark.createDataFrame(rows, ["f", "price"]).repartition(3)


def test_dense_lines_and_pairs_add_up_alike(vectors, monkeypatch):
    rows = vectors.select("f", "price")
    lines = moments.second_moments(rows, 10)
    monkeypatch.setattr(moments, "DENSE", 1)
    monkeypatch.setattr(moments, "PAIRS", 500)
    assert np.allclose(lines, moments.second_moments(rows, 10), rtol=1e-12)
    found = np.array([[1.0, *r.f.toArray(), r.price] for r in rows.collect()])
    assert np.allclose(lines, found.T @ found, rtol=1e-12)


@pytest.mark.parametrize("settings", [{}, {"regParam": 0.5}, {"regParam": 20.0, "elasticNetParam": 1.0}, {"regParam": 9.0, "fitIntercept": False}])
def test_model_is_that_of_all_rows(vectors, settings):
    estimator = M.linear(features="f")
    estimator = estimator.copy({getattr(estimator, k): v for k, v in settings.items()})
    own, ours = estimator.fit(vectors), M.fit(estimator, vectors)
    assert not ours.hasSummary and not ours.isSet("weightCol")
    pairs = M.predict(own, vectors, "own").join(M.predict(ours, vectors, "ours").select("f", "price", "ours"), ["f", "price"])
    assert pairs.agg(F.max(F.abs(F.col("own") - F.col("ours")))).first()[0] < 1e-3
    if settings.get("regParam"):
        assert np.allclose(own.coefficients.toArray(), ours.coefficients.toArray(), atol=1e-3)


def test_rows_without_a_number_are_refused_as_before(spark, vectors):
    bad = vectors.unionAll(spark.createDataFrame([(Vectors.dense([float("nan")] * 10), 1.0)], ["f", "price"]))
    with pytest.raises(Exception):
        M.fit(M.ridge(features="f"), bad)
    constant = vectors.withColumn("price", F.lit(7.25))
    assert M.fit(M.ridge(features="f"), constant).intercept == pytest.approx(7.25)


def test_a_grid_passes_over_each_side_once(vectors, monkeypatch):
    seen = []
    monkeypatch.setattr(moments, "second_moments", lambda rows, size, own=moments.second_moments: seen.append(1) or own(rows, size))
    train, test = vectors.randomSplit([0.7, 0.3], 3)
    grid = {"regParam": (0.0, 5.0, 500.0), "elasticNetParam": (0.0,)}
    got = T.grid_search(M.linear(features="f"), grid, train, test).collect()
    assert len(seen) == 1 and [r.regParam for r in got] == [0.0, 5.0, 500.0]
    for r in got:
        plain = M.linear(features="f")
        own = plain.copy({plain.regParam: r.regParam}).fit(train)
        assert (r.train_r2, r.test_r2) == pytest.approx((own.summary.r2, own.evaluate(test).r2), abs=1e-7)
