"""The data behind histograms, box plots, bar charts and pair plots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.columns import hash_text
from lotwise.operators.quantiles import quantiles


def histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """Rows in each of ``bins`` equal-width bins from minimum to maximum.

    The last bin is closed, empty bins are listed with 0, and a column with a
    single value gets bins of total width 1 around it. Nulls, NaN and infinite
    values are left out.
    """
    x = F.col("x")
    seen = df.select(F.col(name).cast("double").alias("x")).where(F.abs(x) < float("inf"))
    low, high = seen.agg(F.min("x"), F.max("x")).first()
    if low is not None and low == high:
        low, high = low - 0.5, high + 0.5
    lo, hi = (F.lit(end).cast("double") for end in (low, high))
    width = (hi - lo) / F.lit(bins)
    position = F.least(F.floor((x - lo) / width).cast("int"), F.lit(bins - 1))
    counted = seen.groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("low"),
        (lo + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, name: str, whisker: float = 1.5, rel_err: float = 0.0) -> DataFrame:
    """Quartiles, whiskers (last values within ``whisker`` ranges) and outliers; NaN counts as null."""
    q1, median, q3 = quantiles(df, name, [0.25, 0.5, 0.75], rel_err, interpolate=rel_err <= 0)
    x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    quartiles = [F.lit(v).cast("double").alias(c) for v, c in ((q1, "q1"), (median, "median"), (q3, "q3"))]
    reach = F.lit(None if q1 is None else whisker * (q3 - q1)).cast("double")
    low_end, high_end = F.lit(q1).cast("double") - reach, F.lit(q3).cast("double") + reach
    measured = df.agg(
        F.least(F.min(F.when(x >= low_end, x)), F.lit(q1).cast("double")).alias("whisker_low"),
        F.greatest(F.max(F.when(x <= high_end, x)), F.lit(q3).cast("double")).alias("whisker_high"),
        F.count_if((x < low_end) | (x > high_end)).alias("outliers"),
        F.count(x).alias("n"),
    )
    return measured.select(*quartiles, "whisker_low", "whisker_high", "outliers", "n")


def _mean_and_interval(value: str, z: float) -> list[Column]:
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.avg(value) - half).alias("ci_low"),
        (F.avg(value) + half).alias("ci_high"),
    ]


def group_mean_ci(df: DataFrame, by: str, value: str = "price", z: float = 1.96) -> DataFrame:
    """Mean per group with the normal interval ``mean ± z * s / sqrt(n)``.

    The interval is an approximation to a bootstrap of the mean, which
    ``group_mean_bootstrap`` draws; it is null for a group of one row.
    """
    return df.groupBy(by).agg(*_mean_and_interval(value, z))


#: A Poisson weight of mean 1 is the number of these that a 16-bit number reaches.
POISSON = tuple(
    math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) + 0.5) for k in range(8)
)
#: Weights that one hash of a row gives, 16 bits each.
WEIGHTS_PER_HASH = 8


def bootstrap_hashes(draws: int, seed: int, key: Sequence[str]) -> Column:
    """The bytes that say how often a row is in each of ``draws`` samples: hashes of its key end to end."""
    hashes = [
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(i)), *[F.col(k).cast("string") for k in key]))
        for i in range(math.ceil(draws / WEIGHTS_PER_HASH))
    ]
    return F.unhex(F.concat(*hashes))


def _sampled_sums(rows: DataFrame, draws: int, whole: bool) -> DataFrame:
    """Rows (group, n, total, weights, totals): of each group in each batch of (group, value, hashes), the sums of all samples.

    ``whole`` numbers are added up as such.
    """
    kind, number = (T.LongType(), np.int64) if whole else (T.DoubleType(), np.float64)
    schema = T.StructType([T.StructField("group", rows.schema[0].dataType)])
    for name, of in (("n", T.LongType()), ("total", kind), ("weights", T.ArrayType(T.LongType())), ("totals", T.ArrayType(kind))):
        schema.add(name, of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.searchsorted(POISSON, np.arange(1 << 16), side="right").astype(np.int8)
        for batch in batches:
            n, group = batch.num_rows, batch.column(0)
            if not n:
                continue
            # Groups of a kind that Arrow does not number are put together by Spark alone.
            nested, code = pa.types.is_nested(group.type), np.arange(n)
            if not nested:
                code = group.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            drawn = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(n, -1)[order, :draws]
            weight = times[drawn].astype(number)
            value = batch.column(1).to_numpy(zero_copy_only=False).astype(number)[order]
            weights, totals = np.add.reduceat(weight, first), np.add.reduceat(weight * value[:, None], first)
            ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * draws)
            yield pa.RecordBatch.from_arrays(
                [
                    group.take(pa.array(order[first])), pa.array(np.diff(first, append=n)), pa.array(np.add.reduceat(value, first)),
                    pa.ListArray.from_arrays(ends, pa.array(weights.ravel().astype(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(totals.ravel())),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(add, schema)


def group_mean_bootstrap(
    df: DataFrame,
    by: str,
    key: Sequence[str],
    value: str = "price",
    draws: int = 96,
    level: float = 0.95,
    seed: int = 23,
) -> DataFrame:
    """Mean per group with a bootstrap interval: quantiles of the means of ``draws`` samples.

    A sample takes every row a Poisson number of times, so all samples are
    weighted sums, taken for a whole Arrow batch at a time, which combine in the tasks: no row is copied,
    and a group that holds a third of the rows is one row of sums per task. Weights
    depend on ``seed`` and ``key`` only, so neither partitions nor a re-run task change the
    result; rows with equal keys are sampled together. Rows without a value do not count; a sample
    in which a group has no row is left out of its quantiles.
    """
    whole = isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType))
    number = F.col(value).cast("long" if whole else "double")
    drawn = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_group"), number.alias("_value"), bootstrap_hashes(draws, seed, key).alias("_hashes"))
    mean = F.sum("total") / F.sum("n")
    sums = _sampled_sums(drawn, draws, whole).groupBy(F.col("group").alias(by)).agg(
        F.sum("n").alias("n"),
        mean.cast(df.select(F.avg(value)).schema[0].dataType).alias("mean"),
        F.array(*[F.try_divide(F.sum(F.col("totals")[i]).cast("double"), F.sum(F.col("weights")[i])) for i in range(draws)]).alias("_means"),
    )
    ordered = F.sort_array(F.array_compact("_means"))
    place = lambda share: (F.size("_means") - 1) * F.lit(share)

    def quantile(share: float) -> Column:
        at = F.floor(place(share)).cast("int")
        low = F.get("_means", at)
        high = F.get("_means", F.least(at + 1, F.size("_means") - 1))
        return low + (high - low) * (place(share) - at)

    tail = (1 - level) / 2
    return sums.withColumn("_means", ordered).select(
        by, "n", "mean", quantile(tail).alias("ci_low"), quantile(1 - tail).alias("ci_high")
    )


def group_mean_2d(
    df: DataFrame,
    by: str,
    hue: str,
    value: str = "price",
    z: float = 1.96,
    pivot_values: Sequence | None = None,
) -> DataFrame:
    """Mean per pair of groups, long; ``pivot_values`` gives one column per hue."""
    if pivot_values is not None:
        return df.groupBy(by).pivot(hue, list(pivot_values)).agg(F.avg(value))
    return df.groupBy(by, hue).agg(*_mean_and_interval(value, z))


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson r of every pair over rows where both are present, long form."""
    names = list(names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    measured = df.agg(*[F.corr(names[i], names[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(names[i]).alias("x_col"),
            F.lit(names[j]).alias("y_col"),
            F.col(f"r_{min(i, j)}_{max(i, j)}").alias("r"),
        )
        for i in range(len(names))
        for j in range(len(names))
    ]
    return measured.select(F.inline(F.array(*cells)))


def sample_n(df: DataFrame, n: int, seed: int = 23, key: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows, the same ones on every run.

    Each task keeps its ``n`` smallest hashes, so the table is not sorted. Rows
    with equal keys are equal draws; give ``key`` columns that tell rows apart.
    """
    names = list(key or df.columns)
    return df.orderBy(hash_text(seed, names), *names).limit(n)


def pair_plot_data(
    df: DataFrame, names: Sequence[str], n: int = 100, seed: int = 23, key: Sequence[str] = ()
) -> DataFrame:
    """Points of every ordered pair of columns for ``n`` sampled rows.

    A column paired with itself gives its sampled distribution.
    """
    sample = sample_n(df, n, seed, key)
    cells = [
        F.struct(
            F.lit(a).alias("x_col"),
            F.lit(b).alias("y_col"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for a in names
        for b in names
    ]
    return sample.select(F.inline(F.array(*cells)))
