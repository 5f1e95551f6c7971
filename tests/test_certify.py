"""The evidence holds for the model that is claimed and for no other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.operators import certify as C
from lotwise.operators import features as X
from lotwise.operators import models as M
from lotwise.operators.levels import LevelIndexerModel
from lotwise.sources.workspace import materialize

SPEC = X.FeatureSpec(numeric=("a", "b"), categorical=("c", "d"), label="y")


@pytest.fixture(scope="module")
def fitted(spark):
    """Rows with their vectors, whose label is not linear in the features, and the fitted features."""
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100))
    rows = spark.range(3000).select(
        "id",
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("int").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)).cast("int").alias("b"),
        F.element_at(F.array(*map(F.lit, "xxxyyzw")), (F.col("id") % 7 + 1).cast("int")).alias("c"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("d"), F.col("id") % 3)).alias("d"),
    ).withColumn("y", F.col("a") * F.col("b") + F.when(F.col("c") == "x", 200).otherwise(0) + noise)
    features = X.feature_pipeline(rows, SPEC)
    return materialize(features.transform(rows), "rows"), features


def indexer(features):
    return next(s for s in features.stages if isinstance(s, LevelIndexerModel))


def far(rows, features, estimator, reg, mix) -> float:
    """Largest distance between the means that a model implies and those of the label."""
    model = M.fit(estimator, rows)
    got = C.stationary_means(model, indexer(features), M.predict(model, rows), SPEC, reg, mix).collect()
    frame = rows.select("y", "c", "d", vector_to_array(X.SCALED_VECTOR).alias("z")).toPandas()
    z = np.array(frame.z.tolist())
    true = {("a", None): (frame.y * z[:, 0]).mean(), ("b", None): (frame.y * z[:, 1]).mean()}
    for c in ("c", "d"):
        true |= {(c, v): m for v, m in frame.groupby(c).y.mean().items()}
    assert {(r.column_name, r.value) for r in got} == set(true) and len(got) == len(true)
    return max(abs(r.mean_label - true[r.column_name, r.value]) for r in got)


def test_linear_models_balance_their_penalty(fitted):
    rows, features = fitted
    assert far(rows, features, M.linear("y"), 0.0, 0.0) < 1e-4
    assert far(rows, features, M.ridge("y"), 0.5, 0.0) < 1e-6
    tight = M.lasso("y")
    tight = tight.copy({tight.tol: 1e-12, tight.maxIter: 2000})
    assert far(rows, features, tight, 0.1, 1.0) < 1e-3
    # A penalty so large that many coefficients are zero: their residuals stay within the bounds.
    large = M._linear(X.FEATURES, "y", regParam=20.0, elasticNetParam=1.0)
    large = large.copy({large.tol: 1e-12, large.maxIter: 2000})
    assert 0 in M.fit(large, rows).coefficients.toArray()
    assert far(rows, features, large, 20.0, 1.0) < 1e-3
    both = M._linear(X.FEATURES, "y", regParam=2.0, elasticNetParam=0.3)
    both = both.copy({both.tol: 1e-12, both.maxIter: 2000})
    assert far(rows, features, both, 2.0, 0.3) < 1e-3


def test_another_penalty_is_seen(fitted):
    rows, features = fitted
    assert far(rows, features, M.ridge("y"), 0.6, 0.0) > 0.01
    assert far(rows, features, M.ridge("y"), 0.5, 0.2) > 0.01
    assert far(rows, features, M.lasso("y"), 0.12, 1.0) > 0.01
    assert far(rows, features, M.linear("y"), 0.1, 0.0) > 0.01
    assert far(rows, features, M.ridge("y"), 0.0, 0.0) > 0.01


def evidence(model, rows, step=1.0, bagged=False):
    return sorted(C.tree_evidence(model, rows, "y", step, bagged).collect(), key=lambda r: r.tree)


def test_tree_leaves_are_means_and_no_split_is_beaten(fitted):
    rows, _ = fitted
    model = M.fit(M.decision_tree("y"), rows)
    (row,) = evidence(model, rows)
    mean = rows.agg(F.avg("y")).first()[0]
    assert (row.depth, row.rows, row.off_leaves, row.off_predictions) == (5, 3000, 0, 0)
    assert row.mean_output == pytest.approx(mean)
    assert C.beaten_splits(model, rows, "y").count() == 0
    # Trained on other labels, its leaves are off and its splits are beaten.
    other = rows.withColumn("y", F.when(F.col("c") == "x", 500.0).otherwise(F.col("b")))
    (row,) = evidence(model, other)
    assert row.off_leaves > 0
    assert C.beaten_splits(model, other, "y").count() > 0


def test_routes_are_those_of_the_model(fitted):
    rows, _ = fitted
    model = M.fit(M.decision_tree("y").copy({M.decision_tree("y").maxDepth: 7}), rows)
    (tree,), used = C.read_trees(model)
    frame = model.transform(rows).select(vector_to_array(X.FEATURES).alias("v"), "prediction").toPandas()
    leaves = C.route(tree, np.array(frame.v.tolist())[:, used])
    assert (tree.left[leaves] < 0).all()
    assert np.allclose(tree.value[leaves], frame.prediction)


def test_boosted_trees_fit_what_is_left(fitted):
    rows, _ = fitted
    estimator = M.gbt("y", maxIter=6, maxDepth=3, stepSize=0.2)
    model = M.fit(estimator, rows)
    found = evidence(model, rows, 0.2)
    assert [r.tree for r in found] == list(range(6)) and {r.depth for r in found} == {3}
    assert sum(r.off_leaves for r in found) == 0 and {r.off_predictions for r in found} == {0}
    assert all(abs(r.mean_output) < 1e-9 for r in found[1:])
    wrong = evidence(model, rows, 0.21)
    assert sum(r.off_leaves for r in wrong) > 20 and wrong[0].off_predictions > 2900
    assert len(evidence(M.fit(estimator.copy({estimator.maxIter: 5}), rows), rows, 0.2)) == 5


def test_forest_is_the_mean_of_trees_on_samples(fitted):
    rows, _ = fitted
    model = M.fit(M.random_forest("y"), rows)
    found = evidence(model, rows, bagged=True)
    assert len(found) == 20 and sum(r.off_leaves for r in found) == 0 and {r.off_predictions for r in found} == {0}
    # Its leaves are means of samples, not of the rows themselves.
    assert sum(r.off_leaves for r in evidence(model, rows)) > 50
    moved = rows.withColumn("y", F.col("y") + F.when(F.col("c") == "x", 150).otherwise(0))
    assert sum(r.off_leaves for r in evidence(model, moved, bagged=True)) > 0


def test_dense_vectors_are_read_as_well(fitted):
    rows, _ = fitted
    dense = rows.withColumn(X.FEATURES, F.col(X.SCALED_VECTOR))
    model = M.fit(M.decision_tree("y"), dense)
    (row,) = evidence(model, dense)
    assert (row.rows, row.off_leaves, row.off_predictions) == (3000, 0, 0)


def test_constant_label_is_one_leaf(fitted):
    rows, _ = fitted
    flat = rows.withColumn("y", F.lit(7.0))
    model = M.fit(M.decision_tree("y"), flat)
    (row,) = evidence(model, flat)
    assert (row.depth, row.leaves, row.mean_output, row.off_leaves, row.off_predictions) == (0, 1, 7.0, 0, 0)
    assert C.beaten_splits(model, flat, "y").count() == 0


def test_evidence_of_trees_takes_one_pass_of_any_step(fitted, monkeypatch):
    """What is asked twice of it routed all rows twice; rows that do not fit the answers at once are taken in steps."""
    rows, _ = fitted
    model = M.fit(M.gbt("y", maxIter=5, maxDepth=7, stepSize=0.3), rows)
    trees, used = C.read_trees(model)
    x = np.random.default_rng(1).choice([0.0, 1.0, 0.3, -0.8], (500, len(used)))
    assert all((got == C.route(tree, x)).all() for got, tree in zip(C._Walk(trees).leaves(x), trees))
    found = C.tree_evidence(model, rows, "y", 0.3)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(C, "ANSWERS", 2000)
    close = ("tree", "depth", "leaves", "rows", "off_leaves", "off_predictions")
    told = [sorted(map(tuple, f.select(*close).collect())) for f in (found, C.tree_evidence(model, rows, "y", 0.3))]
    assert told[0] == told[1] and [(r[3], r[4], r[5]) for r in told[0]] == [(3000, 0, 0)] * 5
