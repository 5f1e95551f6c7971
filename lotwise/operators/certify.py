"""Evidence that a fitted model is what its settings say.

A score alone does not tell a model from another that scores nearly as well. What
must hold of the model on its own training rows does: a linear model's residuals
balance the penalty in every slot, a tree's leaf is the mean of the rows that fall
in it, a boosted tree's leaf the mean of what the trees before left over, a
forest's leaf the mean of a sample. Each check takes the settings that are claimed
as arguments and never asks the model for them, so another setting fails it.

Every check is one pass over the rows. The nodes of trees are read from the saved
model as a table and go to the tasks with the code: they are no larger than the
model, which the driver holds as well. What leaves a task is a sum for each node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.features import SCALED_VECTOR, FeatureSpec
from lotwise.operators.levels import LevelIndexerModel
from lotwise.sources.workspace import materialize, new_path, scope

# ---- linear models


def stationary_means(
    model: LinearRegressionModel,
    indexer: LevelIndexerModel,
    rows: DataFrame,
    spec: FeatureSpec,
    reg: float,
    mix: float,
) -> DataFrame:
    """What the mean label of every level must be if the model is optimal; one row per level and number.

    ``rows`` are the training rows with raw columns, scaled numbers and
    predictions. At the optimum the residuals of a slot add up to the slope of
    the penalty there, so the mean label of a level is the mean prediction plus
    that slope. Where a coefficient is zero the slope of the absolute value may be
    anything from -1 to 1: the residuals choose. For numbers the mean is that of
    the label times the scaled number.
    """
    spark = rows.sparkSession
    label, weights = spec.label, model.coefficients.toArray()
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    width = len(spec.numeric)
    residual = F.col(label) - F.col("prediction")
    # (1/n) * sum of residual * slot = the penalty's slope, of which ``deviation`` is the slot's.
    smooth = F.lit(reg * (1 - mix) / spread) * F.col("deviation") ** 2 * F.col("weight")
    bound = F.lit(reg * mix) * F.col("deviation")
    free = F.greatest(-bound, F.least(bound, F.col("balance") - smooth))
    sharp = F.when(F.col("weight") != 0, F.signum("weight") * bound).otherwise(free)
    tables = []
    if width:
        scaled = vector_to_array(SCALED_VECTOR)
        cells = [
            F.struct(
                F.lit(name).alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(i).cast("long").alias("slot"),
                F.avg(scaled[i] * F.col("prediction")).alias("mean"), F.avg(scaled[i] * residual).alias("balance"),
                F.count(F.lit(1)).alias("rows"), F.stddev_pop(scaled[i]).alias("deviation"),
            )
            for i, name in enumerate(spec.numeric)
        ]
        tables.append(rows.agg(F.array(*cells).alias("c")).select(F.inline("c")).withColumn("share", F.lit(1.0)))
    if spec.categorical:
        texts = rows.select(*[F.col(c).cast("string").alias(c) for c in spec.categorical], "prediction", residual.alias("residual"))
        long = texts.unpivot(["prediction", "residual"], list(spec.categorical), "column_name", "value").where(F.col("value").isNotNull())
        sums = long.groupBy("column_name", "value").agg(
            F.avg("prediction").alias("mean"), (F.sum("residual") / F.lit(n)).alias("balance"), F.count(F.lit(1)).alias("rows")
        )
        share = F.col("rows") / F.lit(n)
        sums = sums.withColumn("share", share).withColumn("deviation", F.sqrt(share * (1 - share)))
        tables.append(sums.join(_slots(indexer, spec, width), ["column_name", "value"]))
    coefficients = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "slot long, weight double")
    found = None
    for table in tables:
        found = table if found is None else found.unionByName(table)
    judged = found.join(coefficients, "slot")
    return judged.select("column_name", "value", "rows", (F.col("mean") + (smooth + sharp) / F.col("share")).alias("mean_label"))


def _slots(indexer: LevelIndexerModel, spec: FeatureSpec, width: int) -> DataFrame:
    """Column, value and slot of every level."""
    offset, table = width, None
    for name, size in zip(spec.categorical, indexer.getOrDefault(indexer.sizes)):
        levels = indexer.levels(name)
        if levels is not None:
            part = levels.select(F.lit(name).alias("column_name"), "value", (F.col("level") + offset).alias("slot"))
            table = part if table is None else table.unionAll(part)
        offset += size
    return table


# ---- trees


@dataclass(frozen=True)
class Tree:
    """Nodes of a tree by their number; ``left`` is -1 at leaves."""

    left: np.ndarray
    right: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    category: np.ndarray
    zero_left: np.ndarray
    one_left: np.ndarray
    value: np.ndarray
    mean: np.ndarray
    gain: np.ndarray
    depth: int


def tree_nodes(model) -> DataFrame:
    """Nodes of a saved tree or ensemble: tree, id, value, sums, gain, children and split."""
    spark = SparkSession.active()
    path = new_path(spark, "nodes")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if isinstance(model, DecisionTreeRegressionModel):
        data = data.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    node = lambda name: F.col(f"nodeData.{name}")
    return data.select(
        F.col("treeID").alias("tree"), node("id").alias("id"), node("prediction").alias("value"),
        (node("impurityStats")[1] / node("impurityStats")[0]).alias("mean"), node("gain").alias("gain"),
        node("leftChild").alias("left"), node("rightChild").alias("right"), node("split.featureIndex").alias("feature"),
        node("split.leftCategoriesOrThreshold").alias("at"), (node("split.numCategories") > 0).alias("category"),
    )


def read_trees(model) -> tuple[list[Tree], np.ndarray]:
    """All trees of a model and the features that they split on; ``column`` counts among these."""
    with scope(SparkSession.active()):
        rows = sorted(tree_nodes(model).collect(), key=lambda r: (r["tree"], r["id"]))
    used = np.array(sorted({r["feature"] for r in rows if r["left"] >= 0}), np.int64)
    trees = []
    for _, mine in groupby(rows, key=lambda r: r["tree"]):
        mine = list(mine)
        place = {r["id"]: i for i, r in enumerate(mine)}
        inner = np.array([r["left"] >= 0 for r in mine])
        left = np.array([place.get(r["left"], -1) for r in mine])
        right = np.array([place.get(r["right"], -1) for r in mine])
        depths = np.zeros(len(mine), int)
        for i in np.flatnonzero(inner):  # children come after their parent
            depths[[left[i], right[i]]] = depths[i] + 1
        at = [list(r["at"] or []) for r in mine]
        trees.append(Tree(
            left, right, np.searchsorted(used, [max(r["feature"], 0) if i else used[0] if len(used) else 0 for r, i in zip(mine, inner)]),
            np.array([a[0] if a else 0.0 for a in at]), np.array([bool(r["category"]) for r in mine]),
            np.array([0.0 in a for a in at]), np.array([1.0 in a for a in at]),
            np.array([r["value"] for r in mine]), np.array([r["mean"] for r in mine]), np.array([r["gain"] for r in mine]),
            int(depths.max()),
        ))
    return trees, used


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row; ``x`` has the features that the model splits on."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(tree.depth):
        inner = tree.left[at] >= 0
        v = x[rows, tree.column[at]]
        left = np.where(tree.category[at], np.where(v != 0, tree.one_left[at], tree.zero_left[at]), v <= tree.threshold[at])
        at = np.where(inner, np.where(left, tree.left[at], tree.right[at]), at)
    return at


class _Walk:
    """All trees of a model on the same rows: each different split is tried once on a row, and a row then goes by the answers."""

    def __init__(self, trees: Sequence[Tree]):
        splits: dict[tuple, int] = {}
        self.of, self.kids, self.depths = [], [], [t.depth for t in trees]
        for t in trees:
            inner, of, node = t.left >= 0, np.zeros(len(t.left), np.int64), np.arange(len(t.left))
            told = zip(*(v.tolist() for v in (t.column, t.category, np.where(t.category, 0.0, t.threshold), t.zero_left, t.one_left)))
            of[inner] = [splits.setdefault(split, len(splits)) for split, there in zip(told, inner) if there]
            self.of.append(of)
            kids = np.stack([np.where(inner, t.right, node), np.where(inner, t.left, node)], axis=1)
            self.kids.append(2 * kids.ravel())  # by twice the node, and one more where a row goes left
        self.splits = list(splits)

    def _answers(self, x: np.ndarray) -> np.ndarray:
        """Whether each row goes left at each split; a line is a split."""
        columns, out = np.ascontiguousarray(x.T), np.zeros((max(len(self.splits), 1), len(x)), bool)
        for line, (column, category, threshold, zero_left, one_left) in zip(out, self.splits):
            v = columns[column]
            line[:] = np.where(v != 0, one_left, zero_left) if category else v <= threshold
        return out

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        n, left, rows = len(x), self._answers(x).ravel(), np.arange(len(x))
        for of, kids, depth in zip(self.of, self.kids, self.depths):
            at, line = np.zeros(n, np.int64), np.repeat(of * n, 2)
            for _ in range(depth):
                asked = line.take(at)
                asked += rows
                at += left.take(asked)
                at = kids.take(at)
            yield at >> 1


def _chosen(vectors: pa.StructArray, used: np.ndarray) -> np.ndarray:
    """The columns ``used`` of vectors that Arrow has as (type, size, indices, values)."""
    n, width = len(vectors), len(used)
    x = np.zeros((n, max(width, 1)))
    indices, values = vectors.field("indices"), vectors.field("values")
    dense = np.array(pa.compute.is_null(indices))
    lengths = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(n), lengths)
    flat = np.empty(len(of), np.int64)
    if dense.any():
        starts = np.cumsum(lengths) - lengths
        flat = np.arange(len(of)) - np.repeat(starts, lengths)
    flat[~dense[of]] = indices.flatten().to_numpy(zero_copy_only=False)
    place = np.searchsorted(used, flat)
    hit = (place < width) & (used[np.minimum(place, width - 1)] == flat) if width else np.zeros(len(of), bool)
    x[of[hit], place[hit]] = values.flatten().to_numpy(zero_copy_only=False)[hit]
    return x


#: Relative difference up to which two sums of the same numbers in another order are equal.
CLOSE = 1e-7
#: Answers of rows to splits that a task holds at once.
ANSWERS = 1 << 22
#: Standard errors between the mean of a sample of a leaf's rows and that of all.
SAMPLED = 6.0


def tree_evidence(model, rows: DataFrame, label: str, step: float = 1.0, bagged: bool = False, tolerance: float = CLOSE) -> DataFrame:
    """One row per tree of what its leaves are on the training rows.

    ``rows`` has the model's features and ``label``. Without ``bagged`` the first
    tree is for the label and each next one for twice what is left over after
    ``step`` times the trees before, the slope of the squared loss; a leaf is off
    if its value is not the mean of that over its rows. With ``bagged`` a leaf is off if its
    value is not the mean of its own sample, or is over ``SAMPLED`` standard
    errors from the mean of all its rows. ``off_predictions`` counts rows that
    the model scores otherwise than the trees, routed here and put together.
    """
    trees, used = read_trees(model)
    features = model.getFeaturesCol()
    claimed = [1 / len(trees)] * len(trees) if bagged else [1.0] + [step] * (len(trees) - 1)

    walk, sizes = _Walk(trees), [len(t.value) for t in trees]
    step = max(ANSWERS // max(len(walk.splits), 1), 1)

    def sums(batches):
        added, off = [np.zeros((3, size)) for size in sizes], 0
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                vectors, y, told = (batch.column(i).slice(first, step) for i in range(3))
                y, told = (v.to_numpy(zero_copy_only=False).astype(float) for v in (y, told))
                score = np.zeros(len(y))
                for k, (leaf, tree, weight) in enumerate(zip(walk.leaves(_chosen(vectors, used)), trees, claimed)):
                    target = y if bagged or k == 0 else 2 * (y - score)
                    for line, w in zip(added[k], (None, target, target * target)):
                        line += np.bincount(leaf, weights=w, minlength=sizes[k])
                    score += weight * tree.value[leaf]
                off += int((np.abs(score - told) > tolerance * np.maximum(1.0, np.abs(told))).sum())
        tree, node = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(size) for size in sizes])
        found = np.concatenate(added, axis=1)
        there = np.flatnonzero(found[0])
        columns = [tree[there], node[there], found[0, there], found[1, there], found[2, there]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        columns = [pa.array(np.append(c, last).astype(k.to_pandas_dtype())) for c, last, k in zip(columns, (-1, 0, off, 0, 0), kinds)]
        yield pa.record_batch(columns, ["tree", "node", "rows", "target", "square"])

    spark = rows.sparkSession
    scored = model.transform(rows.select(features, label)).select(features, F.col(label).cast("double"), model.getPredictionCol())
    leaves = scored.mapInArrow(sums, "tree int, node int, rows long, target double, square double")
    # Written, as both what is off and the leaves are read from it, by a caller more than once.
    leaves = materialize(leaves.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("rows", "target", "square")]), "leaves")
    nodes = spark.createDataFrame(
        [(k, i, float(t.value[i]), float(t.mean[i]), t.depth) for k, t in enumerate(trees) for i in np.flatnonzero(t.left < 0).tolist()],
        "tree int, node int, value double, mean double, depth int",
    )
    mean = F.col("target") / F.col("rows")
    scale = tolerance * F.greatest(F.lit(1.0), F.abs(mean), F.sqrt(F.col("square") / F.col("rows")))
    far = F.abs(F.col("value") - mean) > scale
    if bagged:
        variance = F.greatest(F.col("square") / F.col("rows") - mean * mean, F.lit(0.0))
        far = F.abs(F.col("value") - mean) > SAMPLED * F.sqrt(variance / F.col("rows")) + scale
        far = far | (F.abs(F.col("value") - F.col("mean")) > scale)
    off = leaves.where("tree < 0").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("off_predictions"))
    met = nodes.join(leaves, ["tree", "node"], "left").groupBy("tree").agg(
        F.max("depth").alias("depth"), F.count("rows").alias("leaves"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        (F.sum(F.col("rows") * F.col("value")) / F.sum("rows")).alias("mean_output"),
        F.count_if(F.coalesce(far, F.lit(False))).alias("off_leaves"),
    )
    return met.withColumn("off_predictions", off.scalar())


def beaten_splits(model, rows: DataFrame, label: str) -> DataFrame:
    """Nodes of a single tree for which a split on some 0/1 slot would have gained more than the chosen one.

    Every row says of every node on its way which slots it has; sums of that give
    each slot's gain. Columns: node, feature, gain, chosen. Vectors must be assembled ones,
    which are sparse.
    """
    (tree,), used = read_trees(model)
    features = model.getFeaturesCol()
    size = model.numFeatures
    parents = {int(c): i for i in np.flatnonzero(tree.left >= 0).tolist() for c in (tree.left[i], tree.right[i])}

    def sums(batches):
        for batch in batches:
            vectors, y = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if not len(y):
                continue
            at = route(tree, _chosen(vectors, used))
            lengths = pa.compute.list_value_length(vectors.field("values")).to_numpy(zero_copy_only=False).astype(np.int64)
            of, slot = np.repeat(np.arange(len(y)), lengths), vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
            binary = vectors.field("values").flatten().to_numpy(zero_copy_only=False) == 1.0
            of, slot = of[binary], slot[binary].astype(np.int64)
            up = np.full(len(tree.left), -1)
            up[list(parents)] = list(parents.values())
            at, found = up[at], []
            while (at >= 0).any():
                on = at >= 0
                # The node itself has the number after the last slot.
                keys = np.concatenate([at[of][on[of]] * (size + 1) + slot[on[of]], at[on] * (size + 1) + size])
                unique, inverse = np.unique(keys, return_inverse=True)
                labels = np.concatenate([y[of][on[of]], y[on]])
                found.append((unique, np.bincount(inverse), np.bincount(inverse, weights=labels)))
                at = np.where(on, up[np.maximum(at, 0)], -1)
            if found:
                keys, count, total = (np.concatenate([f[i] for f in found]) for i in range(3))
                yield pa.record_batch([pa.array(keys), pa.array(count), pa.array(total)], ["key", "rows", "target"])

    summed = rows.select(features, F.col(label).cast("double")).mapInArrow(sums, "key long, rows long, target double")
    summed = summed.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("target").alias("target"))
    split = summed.select(
        F.floor(F.col("key") / F.lit(size + 1)).cast("int").alias("node"), F.pmod("key", F.lit(size + 1)).alias("feature"), "rows", "target"
    )
    whole = split.where(F.col("feature") == size).select("node", F.col("rows").alias("n"), F.col("target").alias("t"))
    both = split.where(F.col("feature") < size).join(whole, "node").where("rows < n")
    square = lambda t, n: F.try_divide(t * t, n)
    rest = square(F.col("t") - F.col("target"), F.col("n") - F.col("rows"))
    gain = (square(F.col("target"), F.col("rows")) + rest - square(F.col("t"), F.col("n"))) / F.col("n")
    chosen = rows.sparkSession.createDataFrame(
        [(i, float(tree.gain[i])) for i in np.flatnonzero(tree.left >= 0).tolist()], "node int, chosen double"
    )
    compared = both.select("node", "feature", gain.alias("gain")).join(chosen, "node")
    return compared.where(F.col("gain") > F.col("chosen") * (1 + 1e-6) + 1e-6)
