"""Parameter grids for regressors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from hashlib import sha256
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise.operators import moments
from lotwise.operators.evaluate import leaderboard
from lotwise.operators.models import fit

# The 80 points of the full boosted-tree grid.
FULL_GRID = {
    "maxIter": (50, 75, 100, 125),
    "maxDepth": (3, 5, 7, 9),
    "stepSize": (0.01, 0.02, 0.03, 0.04, 0.06),
}
POINT = ("maxIter", "maxDepth", "stepSize")


def grid_points(grid: Mapping[str, Iterable]) -> list[dict]:
    """Every combination, the last parameter changing fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _r2_by_iteration(model, df: DataFrame, label: str) -> list[float]:
    """R² after each boosting iteration, from one pass over ``df``; null if the label is constant or there is no row."""
    spread = df.agg(F.var_pop(F.col(label).cast("double"))).first()[0]
    if not spread:
        return [None] * model.getNumTrees
    return [1 - mse / spread for mse in model.evaluateEachIteration(df, "squared")]


def _boosted_group(estimator: GBTRegressor, iterations, fixed: dict, train, test, fitted) -> list[dict]:
    """All ``maxIter`` values of one setting from its longest fit.

    Boosting adds trees one after another, so the model with fewer iterations
    is the start of the one with more.
    """
    label = estimator.getLabelCol()
    longest = {**fixed, "maxIter": max(iterations)}
    model = fit(estimator.copy({getattr(estimator, p): v for p, v in longest.items()}), train)
    fitted(longest, model)
    on_train, on_test = _r2_by_iteration(model, train, label), _r2_by_iteration(model, test, label)
    return [
        {"maxIter": i, **fixed, "train_r2": on_train[i - 1], "test_r2": on_test[i - 1]}
        for i in iterations
    ]


def _single_point(estimator, point: dict, train, test, fitted) -> list[dict]:
    label = estimator.getLabelCol()
    model = fit(estimator.copy({getattr(estimator, p): v for p, v in point.items()}), train)
    fitted(point, model)
    r2 = [leaderboard({"m": model}, side, label, digits=None).first()["R2"] for side in (train, test)]
    return [{**point, "train_r2": r2[0], "test_r2": r2[1]}]


def _at_once(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """``work`` on each item in threads. Each call takes its own copy of the thread's properties, which Spark changes while a query runs."""
    with ThreadPoolExecutor(max(parallelism, 1)) as pool:
        runs = [inheritable_thread_target(spark)(partial(work, item)) for item in items]
        return list(pool.map(lambda run: run(), runs))


def _linear_points(estimator, points: Sequence[dict], train, test, fitted, parallelism: int) -> list[dict] | None:
    """All points of a linear model from the moments of one pass, and the scores of all from one pass over each side."""
    few = moments.condensed(train) if moments.supports(estimator) else None
    if few is None:
        return None

    def one(point: dict) -> Model:
        model = moments.fit(estimator.copy({getattr(estimator, p): v for p, v in point.items()}), few)
        fitted(point, model)
        return model

    models = {str(i): model for i, model in enumerate(_at_once(train.sparkSession, one, points, parallelism))}
    scores = [
        {r["Model"]: r["R2"] for r in leaderboard(models, side, estimator.getLabelCol(), digits=None).collect()} for side in (train, test)
    ]
    return [{**point, "train_r2": scores[0][str(i)], "test_r2": scores[1][str(i)]} for i, point in enumerate(points)]


#: Parameters of a linear model that change nothing about its moments.
PENALTIES = ("regParam", "elasticNetParam", "maxIter", "tol", "standardization", "fitIntercept")


def _fingerprint(estimator, grid: Mapping[str, Sequence], train: DataFrame, test: DataFrame) -> str:
    """A digest of everything but the point that a score depends on: settings, label and rows of both sides."""
    settings = sorted((p.name, str(v)) for p, v in estimator.extractParamMap().items() if p.name not in grid)
    label = F.col(estimator.getLabelCol()).cast("double")
    facts = [F.count(F.lit(1)), F.sum(label), F.sum(label * label), F.min(label), F.max(label)]
    # Sums of doubles differ in the last digits from run to run.
    sides = [[f"{v:.9g}" if v is not None else "" for v in side.agg(*facts).first()] for side in (train, test)]
    return sha256(repr((type(estimator).__name__, settings, sides)).encode()).hexdigest()[:16]


class _Finished:
    """Scores of finished settings as small written tables, one folder for each, under ``path``.

    A setting's folder has its rows only once they are all written, so a run
    that was killed leaves whole settings or nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None, schema: str, print_of: str):
        self.spark, self.schema, self.rows = spark, schema, []
        self.path = path and f"{path.rstrip('/')}/{print_of}"
        if self.path and self._exists():
            self.rows = [r.asDict() for r in spark.read.schema(schema).parquet(f"{self.path}/*").collect()]

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return found is not None and len(found) > 0

    def has(self, points: Sequence[dict]) -> list[dict] | None:
        """The rows of the points, if all are there."""
        found = [next((r for r in self.rows if all(r[n] == v for n, v in p.items())), None) for p in points]
        return None if None in found else found

    def add(self, rows: list[tuple], name: str) -> None:
        if self.path:
            frame = self.spark.createDataFrame(rows, self.schema).coalesce(1)  # a few rows
            frame.write.mode("overwrite").parquet(f"{self.path}/{sha256(name.encode()).hexdigest()[:16]}")


def grid_search(
    estimator,
    grid: Mapping[str, Sequence],
    train: DataFrame,
    test: DataFrame,
    parallelism: int = 4,
    path: str | None = None,
    fitted: Callable[[dict, Model], None] = lambda point, model: None,
) -> DataFrame:
    """Train and test R² of every grid point; each model is fitted once.

    A boosted estimator is fitted once per setting of the other parameters, not
    once per ``maxIter``; linear models share one pass over each side. Every fit passes over both sides: give written tables
    or held frames.

    With ``path``, in a store that outlives the session, the scores of each
    setting are written there as it is finished, and a run that finds them
    fits only what is absent. Scores count for the same estimator, settings and
    rows; others under the same path are left alone. ``fitted`` is called with each model
    that is fitted, from several threads.
    """
    names, spark = list(grid), train.sparkSession
    columns = (estimator.getFeaturesCol(), estimator.getLabelCol())
    boosted = isinstance(estimator, GBTRegressor) and "maxIter" in grid
    train, test = train.select(*columns), test.select(*columns)
    kinds = {n: "int" if all(isinstance(v, int) for v in grid[n]) else "double" for n in names}
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + ["train_r2 double", "test_r2 double"])
    finished = _Finished(spark, path, schema, _fingerprint(estimator, grid, train, test) if path else "")

    def typed(row: dict) -> tuple:
        point = tuple(int(row[n]) if kinds[n] == "int" else float(row[n]) for n in names)
        return point + tuple(None if row[side] is None else float(row[side]) for side in ("train_r2", "test_r2"))

    def work(point: dict) -> list[tuple]:
        points = [{**point, "maxIter": i} for i in grid["maxIter"]] if boosted else [point]
        known = finished.has(points)
        if known is not None:
            return [typed(r) for r in known]
        if boosted:
            found = _boosted_group(estimator, list(grid["maxIter"]), point, train, test, fitted)
        else:
            found = _single_point(estimator, point, train, test, fitted)
        rows = [typed(r) for r in found]
        finished.add(rows, repr(sorted(point.items())) + repr(sorted(grid["maxIter"]) if boosted else ""))
        return rows

    settings = grid_points({n: v for n, v in grid.items() if not (boosted and n == "maxIter")})
    # With a path each point is scored and written on its own.
    if not path and set(names) <= set(PENALTIES):
        together = _linear_points(estimator, settings, train, test, fitted, parallelism)
        if together is not None:
            return spark.createDataFrame([typed(row) for row in together], schema)
    found = [row for rows in _at_once(spark, work, settings, parallelism) for row in rows]
    order = {tuple(p[n] for n in names): i for i, p in enumerate(grid_points(grid))}
    found.sort(key=lambda row: order[row[: len(names)]])
    return spark.createDataFrame(found, schema)


def grid_search_train(result: DataFrame) -> DataFrame:
    """The train side of a grid result; no model is fitted again for it."""
    return result.drop("test_r2")


def overfit_gap(result: DataFrame) -> DataFrame:
    """Add ``gap``, the train score minus the test score."""
    return result.withColumn("gap", F.col("train_r2") - F.col("test_r2"))


def best_params(result: DataFrame, max_gap: float | None = None) -> DataFrame:
    """The point with the highest test score, its gap within ``max_gap`` if given.

    Equal scores go to the smaller parameters, in column order.
    """
    points = [c for c in result.columns if c not in ("train_r2", "test_r2", "gap")]
    scored = overfit_gap(result)
    if max_gap is not None:
        scored = scored.where(F.col("gap") <= F.lit(max_gap))
    return scored.orderBy(F.desc("test_r2"), *points).limit(1)


def metric_series(result: DataFrame, metric: str = "test_r2", points: Sequence[str] = POINT) -> DataFrame:
    """A metric along the grid in parameter order, labelled like ``75.9.0.06``."""
    label = F.concat_ws(".", *[F.col(p).cast("string") for p in points])
    # The window sees one row per grid point.
    place = F.row_number().over(W.orderBy(*points))
    return result.select(
        place.alias("pos"), label.alias("point"), F.col(metric).alias("value")
    ).orderBy("pos")
