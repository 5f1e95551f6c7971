"""Whitening of embeddings by distributed block matrices.

Entries become whole numbers ``floor(64 * c) + 1000000``. Rows are indexed
without gaps, centred, and dealt into MLlib blocks of ``height`` rows. The
transposed matrix times the matrix is the scatter, whose eigenvectors are found
on the driver; the matrix times the whitening matrix projects all rows. What the
driver holds is a few matrices of dimension by dimension.

Rows whose vector is null or holds a null, a NaN or an infinity are dropped, and
so are rows of another length than most (equal counts: the longer). Entries
beyond 2^46 count as 2^46, so that a number is exact as a double. Components
without variance cannot be scaled to one and have no rows; neither has an empty
table. Null ids, repeated ids and repeated rows are rows like any other. Columns
besides the two named are not read, so their names do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lotwise.sources.workspace import materialize

#: Fixed values of the contract: scale, offset and number of components.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows of a block, and more where there would be over ``BLOCKS`` blocks: their places go through the driver.
HEIGHT, BLOCKS = 1024, 1_000_000
#: Least bytes of blocks that are multiplied in one task, and least multiple of the size of their product.
TASK_BYTES, TASK_TIMES = 8 << 20, 16
LARGEST = float(2**46)
#: Variances below this share of all variance are rounding.
ROUNDING = 1e-12

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Whitening:
    """What a table of vectors has been fitted to; ``rows`` has id, numbers and index."""

    rows: DataFrame
    n: int
    sums: list[int]
    height: int


def _finite(entry: Column) -> Column:
    return entry.isNotNull() & (F.abs(entry.cast("double")) < F.lit(math.inf))


def _whole(entry: Column) -> Column:
    kept = F.greatest(F.least(entry.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.floor(F.lit(float(SCALE)) * kept).cast("long") + F.lit(OFFSET).cast("long")


def whole_numbers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, an array of whole numbers, of the rows that are not dropped."""
    entries = F.col(column)
    valid = vectors.select(F.col(key).alias("vec_id"), entries.alias("entries")).where(
        entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, _finite)
    )
    length = F.size("entries")
    most = valid.groupBy(length.alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    kept = valid.where(length == F.lit(most["length"] if most else 0))
    return kept.select("vec_id", F.transform("entries", _whole).alias("x"))


def fit(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", height: int = HEIGHT) -> Whitening:
    """Numbers, an index without gaps, and the sums, from one written table.

    A row's place in its task is written with it. The index adds the rows of
    the tasks before, one number a task.
    """
    placed = whole_numbers(vectors, key, column).withColumn("place", F.monotonically_increasing_id())
    written = materialize(placed, "vectors")
    task = F.shiftright("place", 33)
    tasks = written.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    starts = tasks.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    index = F.col("start") + F.col("place") - F.shiftleft(task, 33)
    rows = written.join(starts, task == F.col("task")).select("vec_id", "x", index.alias("index"))
    counted = written.select(F.posexplode("x").alias("at", "number")).groupBy("at")
    sums = sorted(tuple(r) for r in counted.agg(F.sum("number"), F.count(F.lit(1))).collect())
    n = sums[0][2] if sums else 0
    return Whitening(rows, n, [s for _, s, _ in sums], max(height, math.ceil(n / BLOCKS)))


def _numbers(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def centred(fitted: Whitening) -> DataFrame:
    """``index`` and ``values``: whole numbers less their mean.

    The whole part of the mean is subtracted exactly, so the offset costs no digits.
    """
    whole = _numbers([s // fitted.n for s in fitted.sums], "long")
    rest = _numbers([s % fitted.n / fitted.n for s in fitted.sums], "double")
    values = F.zip_with(F.zip_with("x", whole, lambda x, m: x - m), rest, lambda x, m: x.cast("double") - m)
    return fitted.rows.select("index", values.alias("values"))


def deviation(fitted: Whitening) -> Column:
    """Sum of (n*x - S)^2 as a long; null where that is beyond a long."""
    n, total = F.lit(fitted.n).cast("long"), _numbers(fitted.sums, "long")
    off = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(x, n), s))
    return F.aggregate(off, F.lit(0).cast("long"), lambda sum_, d: F.try_add(sum_, F.try_multiply(d, d)))


def block_matrix(rows: DataFrame, n: int, dim: int, height: int) -> BlockMatrix:
    """Rows ``index``, ``values`` as blocks of ``height`` rows and all columns; they stay in the JVM."""
    vectors = rows.select(F.col("index").cast("long"), array_to_vector("values").alias("vector"))
    indexed = callMLlibFunc("createIndexedRowMatrix", MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim)
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(height, dim)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix.

    Without splits MLlib sends all blocks of a product with one result block to
    one task. With them a task gets a bounded share of the blocks, and only the
    products of the shares, of dimension by dimension, are added up.
    """
    rows, dim = matrix.numRows(), matrix.numCols()
    share = max(TASK_BYTES, TASK_TIMES * 8 * dim * dim)
    splits = max(1, min(math.ceil(rows / matrix.rowsPerBlock), math.ceil(2 * 8 * rows * dim / share)))
    turned = matrix.transpose()._java_matrix_wrapper
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, dim, dim).toLocalMatrix().toArray()


def components(variance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, at most ``most``, none of no variance."""
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    used = values > ROUNDING * max(np.trace(variance), 0.0)
    return values[used], vectors[:, used]


def project(matrix: BlockMatrix, weights: np.ndarray, spark) -> DataFrame:
    """``index`` and ``z``: all rows times ``weights``."""
    dim, k = weights.shape
    block = ((0, 0), Matrices.dense(dim, k, weights.ravel(order="F").tolist()))
    factor = BlockMatrix(spark.sparkContext.parallelize([block], 1), dim, k, dim, k)
    projected = matrix.multiply(factor).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("z"))


def identity_error(projected: DataFrame, n: int, k: int, height: int) -> float:
    """Largest absolute entry of the rows' covariance less the identity."""
    means = projected.select(F.posexplode("z").alias("at", "number")).groupBy("at").agg(F.avg("number"))
    mean = _numbers([m for _, m in sorted(tuple(r) for r in means.collect())], "double")
    off = projected.select("index", F.zip_with("z", mean, lambda z, m: z - m).alias("values"))
    return float(np.abs(scatter(block_matrix(off, n, k, height)) / n - np.eye(k)).max())


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    most: int = COMPONENTS,
    height: int = HEIGHT,
) -> DataFrame:
    """One row for each vector and component, the component with the largest variance first.

    ``deviation`` is exact, ``whitened`` the projection over the square root of
    the variance, ``explained`` the component's share of all variance, and
    ``identity_error`` says how far the whitened rows are from unit covariance.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors, key, column, height)
    if not fitted.n:
        return spark.createDataFrame([], RESULT)
    dim = len(fitted.sums)
    matrix = block_matrix(centred(fitted), fitted.n, dim, fitted.height)
    variance = scatter(matrix) / fitted.n
    values, directions = components(variance, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    projected = materialize(project(matrix, directions / np.sqrt(values), spark), "whitened")
    error = identity_error(projected, fitted.n, k, fitted.height)
    explained = _numbers((values / np.trace(variance)).tolist(), "double")
    both = fitted.rows.select("vec_id", "index", deviation(fitted).alias("deviation")).join(projected, "index")
    cells = F.zip_with("z", explained, lambda z, e: F.struct(z.alias("whitened"), e.alias("explained")))
    exploded = both.select("vec_id", "deviation", F.posexplode(cells).alias("at", "cell"))
    return exploded.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        "deviation", "cell.whitened", "cell.explained", F.lit(error).alias("identity_error"),
    )
