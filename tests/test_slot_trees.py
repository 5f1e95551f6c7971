"""Trees grown from slots are Spark's trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from lotwise.operators import features as X
from lotwise.operators import models as M
from lotwise.operators import slot_trees
from lotwise.operators.levels import binary_slots
from lotwise.sources.models import load_model, save_model
from lotwise.sources.workspace import materialize

SPEC = X.FeatureSpec(numeric=("a", "b"), categorical=("c", "d"), label="y")


@pytest.fixture(scope="module")
def vectors(spark):
    """Numbers with fewer values than bins, so that Spark's thresholds do not depend on a sample; nulls have no slot."""
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(25)).cast("int").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)).cast("int").alias("b"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(4)), F.lit(60))).alias("c"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("d"), F.col("id") % 3)).alias("d"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).alias("noise"),
    ).withColumn("y", F.col("a") * F.col("b") + F.substring("c", 2, 2).cast("int") % 7 * 30 + F.col("noise") / 37.0)
    return materialize(X.feature_pipeline(rows, SPEC).transform(rows), "rows")


@pytest.mark.parametrize("make", [
    lambda: M.decision_tree("y"),
    lambda: M.gbt("y", maxIter=4, maxDepth=4, stepSize=0.3),
    lambda: M.decision_tree("y").setMinInstancesPerNode(90),
])
def test_predictions_are_those_of_sparks_trees(vectors, make):
    estimator = make()
    assert slot_trees.supports(estimator, vectors)
    mine = M.fit(estimator, vectors)
    theirs = estimator.fit(binary_slots(vectors, X.FEATURES))
    both = M.predict(theirs, M.predict(mine, vectors, "p1"), "p2")
    assert type(mine) is type(theirs)
    assert both.where("abs(p1 - p2) > 1e-8 * greatest(1, abs(p2))").isEmpty()
    importance = mine.featureImportances.toArray() - theirs.featureImportances.toArray()
    assert abs(importance).max() < 1e-8


def test_nodes_in_several_jobs_and_a_new_start_change_nothing(vectors, monkeypatch):
    estimator = M.gbt("y", maxIter=5, maxDepth=3)
    whole = M.fit(estimator, vectors)
    monkeypatch.setattr(slot_trees, "CELLS", 1)
    monkeypatch.setattr(slot_trees, "BLOCK", 16)
    monkeypatch.setattr(slot_trees, "REBASE", 2)
    both = M.predict(M.fit(estimator, vectors), M.predict(whole, vectors, "p1"), "p2")
    assert both.where("abs(p1 - p2) > 1e-8 * greatest(1, abs(p2))").isEmpty()


def test_columns_of_few_values_share_a_code():
    """A row is added up once for each code; sums of columns come out as if counted one by one."""
    told = {"numbers": 2, "size": 2 + 300 + 5 + 2 + 1, "starts": [2, 302, 307, 309]}
    layout = slot_trees._Layout(told, [np.arange(24.0), np.arange(8.0)])
    assert layout.codes == [301, 225, 36]
    rng = np.random.default_rng(3)
    values, node = np.stack([rng.integers(0, m, 500) for m in layout.lengths]), rng.integers(0, 3, 500)
    codes = layout.encode(values)
    counts = [np.bincount(node * m + c, minlength=3 * m) for m, c in zip(layout.codes, codes)]
    slots, bins = layout.unfold([np.stack([c, 2 * c]) for c in counts], 3)
    for j, m in enumerate(layout.lengths):
        want = np.bincount(node * m + values[j], minlength=3 * m).reshape(3, m)
        first = None if j < 2 else told["starts"][j - 2]
        got = bins[j] if j < 2 else slots[:, :, first : first + m - 1]
        assert (got == np.stack([want, 2 * want])[:, :, : got.shape[2]]).all()


def test_columns_with_codes_of_their_own_change_nothing(vectors, monkeypatch):
    estimator = M.gbt("y", maxIter=3, maxDepth=4)
    whole = M.fit(estimator, vectors)
    monkeypatch.setattr(slot_trees, "COMBINED", 12)
    both = M.predict(M.fit(estimator, vectors), M.predict(whole, vectors, "p1"), "p2")
    assert both.where("abs(p1 - p2) > 1e-8 * greatest(1, abs(p2))").isEmpty()


def test_a_model_is_saved_and_settings_of_sparks_trees_stay_there(vectors, tmp_path):
    forest = M.random_forest("y").setNumTrees(3)
    model = M.fit(forest, vectors)
    assert (model.getNumTrees, model.getOrDefault(model.labelCol)) == (3, "y")
    loaded = load_model(save_model(PipelineModel([model]), str(tmp_path / "model")))
    both = M.predict(loaded.stages[0], M.predict(model, vectors, "p1"), "p2")
    assert both.where("p1 != p2").isEmpty()
    assert not slot_trees.supports(M.gbt("y", subsamplingRate=0.5), vectors)
    assert not slot_trees.supports(M.linear("y"), vectors)


def test_bits_of_codes_lead_to_the_same_leaves(monkeypatch):
    """A code is looked up once for all splits of a tree; one with more splits than bits goes node by node."""
    told = {"numbers": 1, "size": 1 + 40 + 5, "starts": [1, 41]}
    layout, rng = slot_trees._Layout(told, [np.arange(8.0)]), np.random.default_rng(5)
    tree = slot_trees._Tree([1.0], [0.0])
    for node in range(12):  # some leaves stay high up
        tree.grow(node, (1.0, int(rng.integers(0, 46)), int(rng.integers(0, 8)), bool(rng.integers(0, 2)), 0.5, 0.0))
    tree.depth = 12
    codes = layout.encode(np.stack([rng.integers(0, m, 3000) for m in layout.lengths]))
    routes = tree.routes(layout)
    assert routes[-1] is not None
    monkeypatch.setattr(slot_trees, "BITS", 11)
    by_node = tree.routes(layout)
    assert by_node[-1] is None
    assert (slot_trees._route(routes, codes) == slot_trees._route(by_node, codes)).all()


@pytest.mark.parametrize("make", [
    lambda: M.gbt("y", maxIter=3, maxDepth=4, stepSize=0.3),
    lambda: M.random_forest("y").setNumTrees(3).setMaxDepth(4),
])
def test_sums_on_the_driver_are_those_of_a_shuffle(vectors, make, monkeypatch):
    """The larger of two children is its parent less the smaller one, and the trees are those that add up every node."""
    asked, adder = [], slot_trees._Data._adder
    monkeypatch.setattr(slot_trees._Data, "_adder", lambda self, trees, nodes: asked.append(len(nodes)) or adder(self, trees, nodes))
    here, few = M.fit(make(), vectors), sum(asked)
    asked.clear()
    monkeypatch.setattr(slot_trees, "CELLS", 1)
    both = M.predict(M.fit(make(), vectors), M.predict(here, vectors, "p1"), "p2")
    assert both.where("abs(p1 - p2) > 1e-8 * greatest(1, abs(p2))").isEmpty()
    # The roots of three trees, and below them one of each two nodes.
    assert 2 * few - 3 == sum(asked)


def test_a_level_takes_one_job_of_one_stage(vectors, monkeypatch):
    """A level had a shuffle, and made the way through a tree once for each node."""
    made, jobs, routes, collect = [], [], slot_trees._Tree.routes, slot_trees.RDD.collect
    told = vectors.schema[X.FEATURES].metadata[slot_trees.SLOTS]
    rows = vectors.select(X.FEATURES, F.col("y").cast("double"))
    cuts = slot_trees._thresholds(rows, 4000, told["numbers"], 32, 1)
    data = slot_trees._Data(slot_trees._chunks(rows, 4000, told, cuts), told, cuts, M.gbt("y", maxDepth=6))
    total = rows.agg(F.sum("y")).first()[0]
    monkeypatch.setattr(slot_trees._Tree, "routes", lambda self, layout: made.append(1) or routes(self, layout))
    monkeypatch.setattr(slot_trees.RDD, "collect", lambda self: jobs.append(1) or collect(self))
    for name in ("reduceByKey", "treeReduce"):
        monkeypatch.setattr(slot_trees.RDD, name, None)
    (tree,) = data.grow([(4000.0, total)])
    assert tree.depth == 6 and len(made) == len(jobs) == 7


@pytest.mark.parametrize("depth", [1, 6, 7, 10])
def test_bands_of_levels_lead_to_the_same_leaves(depth):
    """Six levels at once and then three at a time, as node by node; some leaves are high up."""
    told = {"numbers": 1, "size": 1 + 40 + 5, "starts": [1, 41]}
    layout, rng = slot_trees._Layout(told, [np.arange(8.0)]), np.random.default_rng(7)
    tree, level = slot_trees._Tree([1.0], [0.0], depth=depth), [0]
    for _ in range(depth):
        level = [child for node in level if not node or rng.random() < 0.8 for child in tree.grow(
            node, (1.0, int(rng.integers(0, 46)), int(rng.integers(0, 8)), bool(rng.integers(0, 2)), 0.5, 0.0)
        )]
    codes = layout.encode(np.stack([rng.integers(0, m, 3000) for m in layout.lengths]))
    routes = tree.routes(layout)
    assert len(routes[-1]) == 1 + max(0, -(-(depth - 6) // 3))
    assert (slot_trees._route(routes, codes) == slot_trees._route((*routes[:-1], None), codes)).all()


def test_a_lineage_names_trees_and_does_not_hold_them(spark):
    """Every job sends the lineage of what is left, which had the ways through all trees since it was begun."""
    told = {"numbers": 1, "size": 1 + 40 + 5, "starts": [1, 41]}
    layout, tree = slot_trees._Layout(told, [np.arange(8.0)]), slot_trees._Tree([1.0], [2.0], depth=8)
    for node in range(255):
        tree.grow(node, (1.0, node % 46, node % 8, node % 3 == 0, 0.5, 1.0))
    codes = layout.encode(np.stack([np.arange(3000) % m for m in layout.lengths]))
    sent = slot_trees._sent(spark, tree, 0.5, layout)
    left = slot_trees._less(spark.sparkContext.parallelize([(codes, np.zeros(3000))], 1), [sent])
    assert len(CloudPickleSerializer().dumps(left.func)) < 4000 < len(CloudPickleSerializer().dumps(tree.way(layout)))
    assert (left.first()[1] == -0.5 * tree.value()[slot_trees._route(tree.routes(layout), codes)]).all()
    sent.destroy()
