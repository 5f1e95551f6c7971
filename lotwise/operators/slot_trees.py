"""Trees on assembled vectors, from sums for each slot that a row has.

Spark's trees hold a number for every feature of every row and add it up at every
level, though a vector of slots has one slot for each column. Here a row keeps the
slots that it has and the bins of its numbers. At each level the tasks add up rows and
targets by node and slot; a slot that a row lacks is the node's sum less that of the
rows that have it. Few sums go to the driver, which keeps those of a level, so that of two
children only the smaller one is added up: the other has what is left of the parent.
Many combine by node in a shuffle, and the driver gets the best split of each node.
Splits, gains and leaves are defined as Spark's, and the result is Spark's model.

Rows stay in the executors as arrays of ``CHUNK`` rows. Columns of few values share a
code, so that a row is added up once for each code and not for each column; the
sums of a column are those of the codes. Boosting keeps what is left of the label
next to them.
"""

from __future__ import annotations

import gc
import json
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.levels import SLOTS
from lotwise.sources.workspace import new_path, scope

CHUNK = 1 << 16
#: Rows of a partition, where there are more than for every core one.
PARTITION_ROWS = 4_000_000
#: Sums that a task holds at once; a level with more nodes takes several jobs. The driver takes the sums of all tasks up to as many.
CELLS = 1 << 22
#: Values of a code that columns share.
COMBINED = 256
#: Splits of a band of levels whose sides are the bits of one number; where there are more, rows go node by node.
BITS = 63
#: Levels of the first band, which has a number of 64 bits for a code, and of each next one, which has a byte for a code at each node it begins with.
BANDS = 6, 3
#: Slots whose sums travel together.
BLOCK = 1 << 16
#: Arrays are kept as the bytes that Python reads, as every level takes them again.
HELD = StorageLevel.MEMORY_AND_DISK_DESER
#: Trees after which what is left is taken from the table again, so that no lineage is longer.
REBASE = 50

MODELS = {
    DecisionTreeRegressor: DecisionTreeRegressionModel,
    RandomForestRegressor: RandomForestRegressionModel,
    GBTRegressor: GBTRegressionModel,
}
NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, "
    "rightChild int, split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


def supports(estimator, rows: DataFrame) -> bool:
    """Whether the vectors say how many numbers and slots they have, and no setting is one that only Spark's trees have."""
    told = rows.schema[estimator.getFeaturesCol()].metadata.get(SLOTS, {})
    if type(estimator) not in MODELS or not told.get("starts"):
        return False
    boosted, forest = isinstance(estimator, GBTRegressor), isinstance(estimator, RandomForestRegressor)
    plain = {"weightCol": None, "minWeightFractionPerNode": 0.0, "subsamplingRate": 1.0, "bootstrap": True,
             "validationIndicatorCol": None, "lossType": "squared", "featureSubsetStrategy": "all" if boosted else "auto"}
    set_to = {n: estimator.getOrDefault(n) for n in plain if estimator.hasParam(n) and estimator.isDefined(n)}
    return all(v == plain[n] for n, v in set_to.items()) and not (forest and estimator.getNumTrees() == 1)


class _Layout:
    """How the columns of a row, numbers as bins first, are held as codes.

    A column's value is its bin or its slot from the column's first one, the number of
    its slots where it has none. A code is the values of a group of columns in mixed radix;
    columns of more than ``COMBINED`` values are groups of their own.
    """

    def __init__(self, told: dict, cuts: list[np.ndarray]):
        self.size, self.width, self.starts = told["size"], len(cuts), list(told["starts"])
        self.lengths = [len(c) + 1 for c in cuts] + [b - a + 1 for a, b in zip(self.starts, [*self.starts[1:], self.size])]
        self.groups: list[list[int]] = []
        self.codes: list[int] = []
        self.place: dict[int, tuple[int, int]] = {}
        for j in sorted(range(len(self.lengths)), key=lambda j: -self.lengths[j]):
            g = next((g for g, c in enumerate(self.codes) if c * self.lengths[j] <= COMBINED), len(self.codes))
            if g == len(self.codes):
                self.groups.append([])
                self.codes.append(1)
            self.place[j] = g, self.codes[g]
            self.groups[g].append(j)
            self.codes[g] *= self.lengths[j]
        self.kind = np.min_scalar_type(max(self.codes) - 1)

    def column(self, feature: int) -> tuple[int, int]:
        """The column of a feature and the value there that stands for it; for a number its bins are its values."""
        if feature < self.width:
            return feature, 0
        j = int(np.searchsorted(self.starts, feature, side="right")) - 1
        return self.width + j, feature - self.starts[j]

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Codes of each group from a row of values for each column."""
        out = np.zeros((len(self.groups), values.shape[1]), np.int64)
        for j, line in enumerate(values):
            g, stride = self.place[j]
            out[g] += line * stride
        return out.astype(self.kind)

    def unfold(self, sums: list[np.ndarray], nodes: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums by node and slot, and by node and bin of each number, from those by node and code."""
        slots, bins = np.zeros((2, nodes, self.size)), [np.zeros(0)] * self.width
        for columns, mine in zip(self.groups, sums):
            # The last column has the longest stride.
            mine = mine.reshape(2, nodes, *[self.lengths[j] for j in reversed(columns)])
            for i, j in enumerate(reversed(columns)):
                others = tuple(2 + a for a in range(len(columns)) if a != i)
                found = mine.sum(axis=others) if others else mine
                if j < self.width:
                    bins[j] = found
                else:
                    first = self.starts[j - self.width]
                    slots[:, :, first : first + self.lengths[j] - 1] = found[:, :, :-1]
        return slots, bins


@dataclass
class _Tree:
    """Nodes by number; a leaf is its own child. ``rows`` and ``total`` are the count and sum of its targets."""

    rows: list[float]
    total: list[float]
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    one_left: list[bool] = field(default_factory=lambda: [False])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    depth: int = 0
    square: list[float] = field(default_factory=list)
    told: dict[int, tuple] = field(default_factory=dict, repr=False)

    def grow(self, node: int, split: tuple) -> list[int]:
        """Split a leaf; its new children."""
        gain, feature, cut, one_left, rows, total = split
        children = [len(self.left), len(self.left) + 1]
        self.left[node], self.right[node] = children
        self.feature[node], self.cut[node], self.one_left[node], self.gain[node] = feature, cut, one_left, gain
        for child, n, t in zip(children, (rows, self.rows[node] - rows), (total, self.total[node] - total)):
            self.left.append(child)
            self.right.append(child)
            for values, none in ((self.feature, -1), (self.cut, 0), (self.one_left, False), (self.gain, -1.0)):
                values.append(none)
            self.rows.append(n)
            self.total.append(t)
        return children

    def settle(self, sums: np.ndarray) -> None:
        """Take rows, targets and their squares of every leaf, and add them up to the root."""
        self.rows, self.total, self.square = (list(map(float, part)) for part in sums)
        for i in reversed(range(len(self.left))):
            if self.left[i] != i:
                for values in (self.rows, self.total, self.square):
                    values[i] = values[self.left[i]] + values[self.right[i]]

    def value(self) -> np.ndarray:
        return np.array(self.total) / np.maximum(self.rows, 1e-300)

    def routes(self, layout: _Layout) -> tuple:
        """What a task needs to send rows to their leaves.

        A node has a stretch of ``left``, which says for each code whether it goes left. For a column
        of its own that is short as well: it begins at ``low`` and all codes from ``top`` on share its end.
        """
        most = min(max(layout.codes), COMBINED)
        group, base, low, top = (np.zeros(len(self.left), t) for t in (np.int64, np.int64, np.uint32, np.uint32))
        left, held = [np.zeros(most, bool)], most  # the first stretch is of leaves, whose children are themselves
        for i, feature in enumerate(self.feature):
            if feature < 0:
                continue
            if i not in self.told:  # the split of a node is never changed
                self.told[i] = self._stretch(i, layout)
            group[i], low[i], top[i], goes = self.told[i]
            base[i] = held
            left.append(goes)
            held += len(goes)
        kids = np.stack([self.right, self.left], axis=1).ravel()
        ends = (low, top) if max(layout.codes) > COMBINED else None
        return self.depth, group, base, np.concatenate(left), ends, kids, None if ends else self._bands(kids)

    def way(self, layout: _Layout) -> tuple:
        """The routes as they are sent: bands need none of what goes node by node, and a lineage keeps those of all its trees."""
        *by_node, bands = self.routes(layout)
        return (*by_node, None) if bands is None else (*[None] * len(by_node), bands)

    def _stretch(self, node: int, layout: _Layout) -> tuple:
        """Group, low and top end of a node's split, and for each code between whether it goes left."""
        j, value = layout.column(self.feature[node])
        group, stride = layout.place[j]
        codes, cut, low = layout.codes[group], self.cut[node], 0
        if codes <= COMBINED:
            values, top = np.arange(codes) // stride % layout.lengths[j], codes - 1
        elif j < layout.width:
            values, top = np.arange(cut + 2), cut + 1
        else:
            values, low, top = np.array([value, -1]), value, 1
        return group, low, top, values <= cut if j < layout.width else (values == value) == self.one_left[node]

    def _bands(self, kids: np.ndarray) -> list[tuple] | None:
        """Levels taken together: all answers that a code gives there as bits of one number.

        A band begins at some nodes. The nodes below each are numbered as in a heap, and that is the bit that
        says whether a code goes right. Where the bits lead is the place in the next band, or the leaf.
        """
        bands, entries, depth = [], np.zeros(1, np.int64), 0
        while depth < self.depth:
            levels = min(BANDS[depth > 0], self.depth - depth)
            kind = np.int64 if depth == 0 else np.uint8
            at, tables, splits = {1: entries}, {}, 0
            for p in range(1, 1 << levels):
                for e, node in enumerate(at[p].tolist()):
                    if node < 0 or self.feature[node] < 0:
                        continue
                    g, _, top, left = self.told[node]
                    table = tables.setdefault(g, (top + 1, np.zeros((len(entries), top + 1), kind)))[1]
                    table[e] |= (~left).astype(kind) << kind(p)
                    splits += 1
                leaf = np.where(at[p] < 0, True, kids[2 * at[p]] == at[p])
                at[2 * p], at[2 * p + 1] = (np.where(leaf, -1, kids[2 * at[p] + s]) for s in (1, 0))
            if splits > BITS * len(entries):
                return None
            ends = np.repeat(entries, 1 << levels).reshape(len(entries), -1)
            for level in reversed(range(levels)):
                ends = kids[2 * ends + 1 - (np.arange(1 << levels) >> level & 1)]
            depth += levels
            entries, exits = np.unique(ends, return_inverse=True)
            found = [(g, codes, table.ravel()) for g, (codes, table) in tables.items()]
            bands.append((levels, found, (ends if depth == self.depth else exits).ravel()))
        return bands


def _route(routes: tuple, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    depth, group, base, left, ends, kids, bands = routes
    n = codes.shape[1]
    at = np.zeros(n, np.int64)
    if bands is not None:
        for levels, tables, exits in bands:
            said = None
            for g, length, table in tables:
                bits = table.take(codes[g] if len(table) == length else at * length + codes[g])
                said = bits if said is None else np.bitwise_or(said, bits, out=said)
            at <<= levels
            if said is not None:
                place = np.ones(n, said.dtype)
                for _ in range(levels):
                    side = said >> place
                    side &= 1
                    place += place
                    place += side
                at += place
                at -= 1 << levels
            at = exits.take(at)
        return at
    rows, flat, line = np.arange(n), codes.ravel(), group * n
    for _ in range(depth):
        code = flat.take(line.take(at) + rows)
        if ends is not None:
            # A code below the low end wraps to a large number.
            code = np.minimum(code.astype(np.uint32) - ends[0].take(at), ends[1].take(at))
        at = kids.take(2 * at + left.take(base.take(at) + code))
    return at


_QUIET = False


def _quiet() -> None:
    """Take what a worker has loaded out of its garbage collection, once: it follows each task and is longer than most of those here."""
    global _QUIET
    if not _QUIET:
        gc.collect()
        gc.freeze()
        _QUIET = True


# ---- rows as arrays


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all entries of a batch of vectors."""
    vectors = batch.column(0)
    values, indices = vectors.field("values"), vectors.field("indices")
    lengths = pa.compute.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = indices.flatten().to_numpy(zero_copy_only=False)
    if indices.null_count:  # dense vectors
        sparse = ~np.array(pa.compute.is_null(indices))[of]
        given, at = at, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at[sparse] = given
    return of, at, values.flatten().to_numpy(zero_copy_only=False)


def _numbers(entries: tuple, width: int, n: int) -> np.ndarray:
    of, at, values = entries
    mine = np.flatnonzero(at < width)
    x = np.zeros((width, n))
    x[at[mine], of[mine]] = values[mine]
    return x


def _thresholds(rows: DataFrame, n: int, width: int, most: int, seed: int) -> list[np.ndarray]:
    """At most ``most - 1`` thresholds for each number, from as many sampled rows as Spark's trees take."""
    if not width:
        return []
    share = min(1.0, max(most * most, 10_000) / max(n, 1))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(list(_numbers(_flat(batch), width, batch.num_rows).T), pa.list_(pa.float64()))], ["x"])

    features = rows.select(rows.columns[0])
    sampled = (features.sample(share, seed) if share < 1 else features).mapInArrow(told, "x array<double>")
    values = np.array([r["x"] for r in sampled.collect()]).reshape(-1, width)
    return [_cuts(*np.unique(column, return_counts=True), most - 1) for column in values.T]


def _cuts(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Middles between neighbours: all, or those next to ``most`` even steps of the counts."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = counts.sum() / (most + 1)
    target, before, chosen = stride, counts[0], []
    for i in range(1, len(values)):
        if abs(before - target) < abs(before + counts[i] - target):
            chosen.append(middles[i - 1])
            target += stride
        before += counts[i]
    return np.array(chosen)


def _chunks(rows: DataFrame, n: int, told: dict, cuts: list[np.ndarray]) -> RDD:
    """Codes of the bins of numbers and of the slot that a row has in each column, and the label."""
    width, starts, layout = len(cuts), np.array(told["starts"]), _Layout(told, cuts)

    def arrays(batch: pa.RecordBatch, place: np.ndarray, value: np.ndarray) -> tuple:
        n = batch.num_rows
        of, at, values = entries = _flat(batch)
        there = np.flatnonzero((at >= width) & (values != 0))
        cells = np.repeat(np.array(layout.lengths)[:, None] - 1, n, axis=1)
        slots = at[there]
        cells.reshape(-1)[place[slots] * n + of[there]] = value[slots]
        for j, (c, v) in enumerate(zip(cuts, _numbers(entries, width, n))):
            cells[j] = np.searchsorted(c, v, side="left")
        return layout.encode(cells), batch.column(1).to_numpy(zero_copy_only=False).astype(float)

    def joined(parts: list[tuple]) -> tuple:
        return np.hstack([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        features = np.arange(layout.size)
        place = width + np.searchsorted(starts, features, side="right") - 1  # columns of slots
        value = features - np.concatenate([np.zeros(1, np.int64), starts])[place - width + 1]
        for batch in batches:
            if batch.num_rows:
                waiting.append(arrays(batch, place, value))
                held += batch.num_rows
            if held >= CHUNK:
                yield pa.record_batch([pa.array([pickle.dumps(joined(waiting), protocol=5)], pa.binary())], ["chunk"])
                waiting, held = [], 0
        if waiting:
            yield pa.record_batch([pa.array([pickle.dumps(joined(waiting), protocol=5)], pa.binary())], ["chunk"])

    parallel = rows.sparkSession.sparkContext.defaultParallelism
    packed = rows.coalesce(max(parallel, ceil(n / PARTITION_ROWS))).mapInArrow(pack, "chunk binary")
    return packed.rdd.map(lambda row: pickle.loads(row["chunk"]))


# ---- growing


@dataclass
class _Data:
    """Rows as arrays, and what is the same for all trees on them."""

    chunks: RDD
    told: dict
    cuts: list[np.ndarray]
    estimator: object
    scale: float = 1.0  # the target is what is left times this
    bagged: bool = False

    def __post_init__(self):
        self.layout = _Layout(self.told, self.cuts)

    def weights(self) -> object:
        """How often a tree takes the rows of a chunk; None for once."""
        seed, bagged = abs(self.estimator.getSeed()), self.bagged

        def draw(part: int, chunk: int, tree: int, n: int) -> np.ndarray | None:
            return np.random.default_rng([seed, part, chunk, tree]).poisson(1.0, n).astype(float) if bagged else None

        return draw

    def leaf_sums(self, trees: list[_Tree]) -> list[np.ndarray]:
        """Rows, targets and squared targets in each leaf of each tree."""
        routes = [t.way(self.layout) for t in trees]
        scale, draw = self.scale, self.weights()
        sizes = [len(t.left) for t in trees]

        def add(part: int, chunks: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
            _quiet()
            sums = [np.zeros((3, s)) for s in sizes]
            for c, (cells, rest) in enumerate(chunks):
                target = rest * scale
                for k, route in enumerate(routes):
                    at, w = _route(route, cells), draw(part, c, k, len(rest))
                    for i, v in enumerate((np.ones(len(rest)), target, target * target)):
                        sums[k][i] += np.bincount(at, weights=v if w is None else v * w, minlength=sizes[k])
            yield sums

        parts = self.chunks.mapPartitionsWithIndex(add)
        if parts.getNumPartitions() * sum(sizes) > CELLS:
            return parts.treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
        return [np.sum(found, axis=0) for found in zip(*parts.collect())]

    def best_splits(
        self, trees: list[_Tree], nodes: list[tuple[int, int]], above: np.ndarray | None = None
    ) -> tuple[dict[tuple[int, int], tuple], np.ndarray | None]:
        """The best split of each node, given as (tree, number) by rising tree; those without one are absent. And the nodes' sums, if they came to the driver.

        ``above`` has the sums of the parents, of which ``nodes`` are the children two by two.
        """
        cells = self.told["size"] + sum(len(c) + 1 for c in self.cuts)
        smaller = nodes if above is None else [min(p, key=lambda at: trees[at[0]].rows[at[1]]) for p in zip(nodes[::2], nodes[1::2])]
        found = {}
        if self.chunks.getNumPartitions() * len(smaller) * cells <= CELLS:
            sums = self._sums(trees, smaller)
            if above is not None:
                first = np.array([s == n for s, n in zip(smaller, nodes[::2])])[:, None, None]
                sums = np.stack([np.where(first, sums, above - sums), np.where(first, above - sums, sums)], axis=1).reshape(-1, 2, cells)
            return self._judged(trees, nodes, sums), sums
        step = max(CELLS // (cells + sum(self.layout.codes)), 1)
        for i in range(0, len(nodes), step):
            for key, split in self._best(trees, nodes[i : i + step]).collect():
                _keep_better(found, key, split)
        return found, None

    def _adder(self, trees: list[_Tree], nodes: list[tuple[int, int]]):
        """What adds up a task's rows and targets for each tree, by its nodes in order: those of slots, then of the bins of each number."""
        scale, draw, layout = self.scale, self.weights(), self.layout
        order: dict[int, list[int]] = {}
        for k, i in nodes:
            order.setdefault(k, []).append(i)
        routes = {k: trees[k].way(layout) for k in order}
        asked = {k: np.full(len(trees[k].left), -1) for k in order}
        for k, mine in order.items():
            asked[k][mine] = np.arange(len(mine))

        def add(part: int, chunks: Iterator[tuple]) -> Iterator[tuple]:
            _quiet()
            by_code = {k: [np.zeros((2, len(order[k]) * m)) for m in layout.codes] for k in routes}
            for c, (cells, rest) in enumerate(chunks):
                for k, route in routes.items():
                    at, w = asked[k][_route(route, cells)], draw(part, c, k, len(rest))
                    on = np.flatnonzero(at >= 0 if w is None else (at >= 0) & (w > 0))
                    if len(on) < len(at):
                        own, mine, y, w = at[on], cells[:, on], rest[on] * scale, None if w is None else w[on]
                    else:
                        own, mine, y = at, cells, rest * scale
                    y = y if w is None else y * w
                    for line, m, sums in zip(mine, layout.codes, by_code[k]):
                        keys = own * m + line
                        sums[0] += np.bincount(keys, weights=w, minlength=sums.shape[1])
                        sums[1] += np.bincount(keys, weights=y, minlength=sums.shape[1])
            for k, mine in order.items():
                yield k, mine, *layout.unfold(by_code.pop(k), len(mine))

        return add

    def _sums(self, trees: list[_Tree], nodes: list[tuple[int, int]]) -> np.ndarray:
        """Rows and targets of each node by cell: slots, then the bins of each number."""
        add = self._adder(trees, nodes)

        def together(part: int, chunks: Iterator[tuple]) -> Iterator[np.ndarray]:
            yield np.concatenate([np.concatenate([slots, *bins], axis=2) for _, _, slots, bins in add(part, chunks)], axis=1)

        return sum(self.chunks.mapPartitionsWithIndex(together).collect()).transpose(1, 0, 2)

    def _judged(self, trees: list[_Tree], nodes: list[tuple[int, int]], sums: np.ndarray) -> dict[tuple[int, int], tuple]:
        """The best splits of nodes whose sums are here."""
        size, found, judge = self.told["size"], {}, self._judge(trees, nodes)
        step = max(BLOCK // sums.shape[2], 1)
        for i in range(0, len(nodes), step):
            mine, at = sums[i : i + step], size
            parts = [("slots", 0, mine[:, :, :size])]
            for j, c in enumerate(self.cuts):
                parts.append(("bins", j, mine[:, :, at : at + len(c) + 1]))
                at += len(c) + 1
            for kind, first, part in parts:
                for key, split in judge(nodes[i : i + step], kind, first, part[:, 0], part[:, 1]):
                    _keep_better(found, key, split)
        return found

    def _judge(self, trees: list[_Tree], nodes: list[tuple[int, int]]):
        """What finds the best splits of nodes on slots from ``first`` on, or on the bins of the number ``first``, from sums with a line for each node."""
        totals = {(k, i): (trees[k].rows[i], trees[k].total[i]) for k, i in nodes}
        size, width = self.told["size"], len(self.cuts)
        least, floor = max(self.estimator.getMinInstancesPerNode(), 1), self.estimator.getMinInfoGain()
        bagged, seed = self.bagged, abs(self.estimator.getSeed())

        def judge(keys: list[tuple[int, int]], kind: str, first: int, rows: np.ndarray, total: np.ndarray) -> Iterator[tuple]:
            n, t = np.array([totals[key] for key in keys]).T[:, :, None]
            # The side of the rows that have the slot, or whose number is up to the cut.
            inner_n, inner_t = (rows, total) if kind == "slots" else (np.cumsum(rows, axis=1)[:, :-1], np.cumsum(total, axis=1)[:, :-1])
            outer_n, outer_t = n - inner_n, t - inner_t
            may = (inner_n >= least) & (outer_n >= least)
            if bagged:
                # A third of the features for each node, as for Spark's forests.
                picked = np.zeros((len(keys), size), bool)
                for line, key in zip(picked, keys):
                    line[np.random.default_rng([seed, *key]).permutation(size)[: ceil(size / 3)]] = True
                may &= picked[:, first : first + may.shape[1]] if kind == "slots" else picked[:, first : first + 1]
            if kind == "slots":
                may[:, : max(width - first, 0)] = False  # those places are of numbers
            if not may.any():
                return
            safe_in, safe_out = np.where(may, inner_n, 1), np.where(may, outer_n, 1)
            gain = (inner_t * inner_t / safe_in + outer_t * outer_t / safe_out - t * t / n) / n
            gain = np.where(may, gain, -np.inf)
            best = np.argmax(gain, axis=1)
            for line, (key, b) in enumerate(zip(keys, best.tolist())):
                won = float(gain[line, b])
                # Gains that are rounding are none.
                if won < floor or won <= 1e-13 * float(t[line, 0] / n[line, 0]) ** 2:
                    continue
                in_n, in_t, out_n, out_t = (float(v[line, b]) for v in (inner_n, inner_t, outer_n, outer_t))
                if kind == "bins":
                    yield key, (won, first, b, False, in_n, in_t)
                    continue
                one_left = in_t / in_n < out_t / out_n
                yield key, (won, first + b, 0, one_left, *((in_n, in_t) if one_left else (out_n, out_t)))

        return judge

    def _best(self, trees: list[_Tree], nodes: list[tuple[int, int]]) -> RDD:
        size, width = self.told["size"], len(self.cuts)
        add, judge = self._adder(trees, nodes), self._judge(trees, nodes)

        def spread(part: int, chunks: Iterator[tuple]) -> Iterator[tuple]:
            for k, mine, slots, bins in add(part, chunks):
                for i, node in enumerate(mine):
                    for first in range(0, size, BLOCK):
                        yield (k, node, "slots", first), slots[:, i, first : min(first + BLOCK, size)].copy()
                    for j, sums in enumerate(bins):
                        yield (k, node, "bins", j), sums[:, i].copy()

        def judged(item: tuple) -> Iterator[tuple]:
            (k, node, kind, first), (rows, total) = item
            return judge([(k, node)], kind, first, rows[None], total[None])

        parts = min(len(nodes) * (width + 1), self.chunks.getNumPartitions())
        return self.chunks.mapPartitionsWithIndex(spread).reduceByKey(lambda a, b: a + b, parts).flatMap(judged)

    def grow(self, roots: list[tuple[float, float]]) -> list[_Tree]:
        """Trees on all rows, level by level together, from the rows and targets at their roots."""
        trees = [_Tree([n], [t]) for n, t in roots]
        open_nodes, above = [(k, 0) for k, t in enumerate(trees) if t.rows[0] > 0], None
        for depth in range(self.estimator.getMaxDepth()):
            if not open_nodes:
                break
            found, sums = self.best_splits(trees, open_nodes, above)
            above = None if sums is None else sums[[key in found for key in open_nodes]]
            open_nodes = []
            for (k, node), split in sorted(found.items()):
                open_nodes += [(k, child) for child in trees[k].grow(node, split)]
                trees[k].depth = depth + 1
        for tree, sums in zip(trees, self.leaf_sums(trees)):
            tree.settle(sums)
        return trees


def _keep_better(found: dict, key: tuple[int, int], split: tuple) -> None:
    """Keep the split of a node with the larger gain; of equal ones that on the earlier feature."""
    if key not in found or split[0] > found[key][0] or (split[0] == found[key][0] and split[1] < found[key][1]):
        found[key] = split


def _sent(spark: SparkSession, tree: _Tree, weight: float, layout: _Layout):
    """A tree's way and the weighted values of its leaves, sent once: a lineage names it, and every job sends the lineage."""
    return spark.sparkContext.broadcast((tree.way(layout), tree.value() * weight))


def _less(chunks: RDD, steps: list) -> RDD:
    """What is left of the label after the trees of ``_sent``."""

    def take(chunk: tuple) -> tuple:
        cells, rest = chunk
        for routes, value in (step.value for step in steps):
            rest = rest - value[_route(routes, cells)]
        return cells, rest

    return chunks.map(take)


def _boost(spark: SparkSession, data: _Data, base: RDD) -> list[tuple[_Tree, float]]:
    """The first tree on the label, each next one on twice what is left, the slope of the squared error."""
    done, steps, weight, before = [], [], 1.0, None
    blank = _Tree([0.0], [0.0])
    rows, total, _ = data.leaf_sums([blank])[0][:, 0]
    try:
        for k in range(data.estimator.getMaxIter()):
            (tree,) = data.grow([(rows, total * data.scale)])  # its first job takes the tree before from the rows
            done.append((tree, weight))
            if before is not None:
                before.unpersist()
            if k + 1 == data.estimator.getMaxIter():
                break
            total = tree.total[0] * (1 / data.scale - weight)
            steps.append(_sent(spark, tree, weight, data.layout))
            tree.told.clear()
            source, since = (base, steps[:]) if (k + 1) % REBASE == 0 else (data.chunks, steps[-1:])
            before, data.chunks = data.chunks, _less(source, since).persist(HELD)
            data.scale, weight = 2.0, data.estimator.getStepSize()
    finally:
        if before is not None:
            before.unpersist()
        for step in steps:
            step.destroy()
    return done


def fit(estimator, rows: DataFrame):
    """The estimator's model, for vectors that ``supports`` accepts."""
    spark = rows.sparkSession
    rows = rows.select(estimator.getFeaturesCol(), F.col(estimator.getLabelCol()).cast("double"))
    told = rows.schema[0].metadata[SLOTS]
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit trees on")
    most = min(estimator.getMaxBins(), n)
    cuts = _thresholds(rows, n, told["numbers"], most, abs(estimator.getSeed()) % 2**31)
    base = _chunks(rows, n, told, cuts)
    data = _Data(base.map(lambda chunk: chunk).persist(HELD), told, cuts, estimator)
    try:
        if isinstance(estimator, GBTRegressor):
            done = _boost(spark, data, base)
        else:
            count = estimator.getNumTrees() if isinstance(estimator, RandomForestRegressor) else 1
            data.bagged = count > 1
            roots = [(float(s[0, 0]), float(s[1, 0])) for s in data.leaf_sums([_Tree([0.0], [0.0])] * count)]
            done = [(t, 1.0) for t in data.grow(roots)]
    finally:
        data.chunks.unpersist()
    return _model(spark, estimator, done, told["size"], cuts)


# ---- Spark's model


def _rows_of(tree: _Tree, cuts: list[np.ndarray]) -> list[tuple]:
    out, value = [], tree.value()
    for i in range(len(tree.left)):
        n, t, q = tree.rows[i], tree.total[i], tree.square[i]
        impurity = max(q / n - (t / n) ** 2, 0.0) if n else 0.0
        feature = tree.feature[i]
        if feature < 0:
            split = (-1, [], -1)
        elif feature < len(cuts):
            split = (feature, [float(cuts[feature][tree.cut[i]])], -1)
        else:
            split = (feature, [1.0 if tree.one_left[i] else 0.0], 2)
        children = (-1, -1) if feature < 0 else (tree.left[i], tree.right[i])
        out.append((i, float(value[i]), impurity, [n, t, q], int(n), float(tree.gain[i]), *children, split))
    return out


def _model(spark: SparkSession, estimator, done: list[tuple[_Tree, float]], size: int, cuts: list[np.ndarray]):
    """Write the trees as Spark saves a model, and load it."""
    model = MODELS[type(estimator)]
    package = "org.apache.spark.ml.regression"
    params = {
        "paramMap": {p.name: v for p, v in estimator._paramMap.items()},
        "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()},
    }
    told = {"class": f"{package}.{model.__name__}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": estimator.uid, **params, "numFeatures": size}
    with scope(spark):
        path = new_path(spark, "trees")
        if isinstance(estimator, DecisionTreeRegressor):
            spark.createDataFrame(_rows_of(done[0][0], cuts), NODE).coalesce(1).write.parquet(f"{path}/data")
        else:
            told["numTrees"] = len(done)
            nodes = [(k, row) for k, (tree, _) in enumerate(done) for row in _rows_of(tree, cuts)]
            schema = f"treeID int, nodeData struct<{NODE}>"
            spark.createDataFrame(nodes, schema, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
            single = {p.name for p in DecisionTreeRegressor().params}
            of_tree = {kind: {n: v for n, v in found.items() if n in single} for kind, found in params.items()}
            about = {**told, **of_tree, "class": f"{package}.{DecisionTreeRegressionModel.__name__}"}
            about = {n: v for n, v in about.items() if n not in ("numFeatures", "numTrees")}
            trees = [(k, json.dumps({**about, "uid": f"{estimator.uid}_{k}"}), float(w)) for k, (_, w) in enumerate(done)]
            spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return model.load(path)
