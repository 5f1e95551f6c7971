"""Counts of rows, nulls and values.

Each operator is one aggregation over the table, whatever the number of
columns. Group counts combine inside each task first, so a value that holds a
third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.columns import percent_of_total
from lotwise.operators.ranks import most_frequent
from lotwise.operators.rows import limit_n, sort_desc



def _nulls(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """One row: nulls in each column; 0, not null, for an empty table."""
    return df.agg(*[_nulls(n).alias(n) for n in names or df.columns])


def null_percentages(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """One row: percent of nulls in each column, as ``<column>_null_percentage``."""
    total = F.count(F.lit(1))
    return df.agg(
        *[percent_of_total(_nulls(n), total).alias(f"{n}_null_percentage") for n in names or df.columns]
    )


def _as_text(field: T.StructField) -> Column:
    """Text that is equal for equal values of the column and only for those."""
    value = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # makes 0.0 of -0.0
    elif isinstance(field.dataType, T.TimestampType):
        value = F.unix_micros(value)
    return value.cast("string").alias(field.name)


def value_tallies(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Rows per value of many columns in one pass: column, value as text, count.

    Rows are short (a column and a value), and equal ones combine in each task,
    so the shuffle carries each distinct value of a column once per task.
    """
    names = list(names or df.columns)
    texts = df.select(*[_as_text(df.schema[n]) for n in names])
    long = texts.unpivot([], names, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, names: Sequence[str] = (), rsd: float | None = None) -> DataFrame:
    """Non-null distinct values per column, one row per column.

    Exact counts shuffle every distinct value of every column once. ``rsd``
    switches to sketches of that relative error, which shuffle only sketches.
    """
    names = list(names or df.columns)
    if rsd is not None:
        counted = df.agg(*[F.approx_count_distinct(n, rsd).alias(n) for n in names])
        return counted.unpivot([], names, "column_name", "distinct_values")
    return _per_column(df, names).agg(F.count_if(F.col("value").isNotNull()).alias("distinct_values"))


def _per_column(df: DataFrame, names: Sequence[str]) -> GroupedData:
    """Tallies grouped by column, with a null of count 0 for columns of an empty table."""
    every = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name"),
        F.lit(None).cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("count"),
    )
    return value_tallies(df, names).unionAll(every).groupBy("column_name")


def unique_values_count(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of one column; null counts as a value."""
    return df.select(name).distinct().agg(F.count(F.lit(1)).alias("unique_records"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per value; null is a value of its own."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("count"))


#: Values of a list up to which Spark's top-k, which ends in one task, makes it.
SHORT_LIST = 10_000


def top_k_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts are taken in value order, null first.

    A longer list than ``SHORT_LIST`` is found by a threshold and not sorted; it is a
    written table, which goes with the scope or the session.
    """
    counts = value_counts(df, name)
    return limit_n(sort_desc(counts, "count", name), k) if k <= SHORT_LIST else most_frequent(counts, name, k)


def top_values(df: DataFrame, limits: dict[str, int]) -> dict[str, list]:
    """The most frequent values of several text columns, from one job.

    At most ``k`` values of each come to the driver.
    """
    parts = [
        top_k_values(df, name, k).select(
            F.lit(name).alias("name"), F.col(name).cast("string").alias("value"), "count"
        )
        for name, k in limits.items()
    ]
    found: dict[str, list] = {name: [] for name in limits}
    if parts:
        union = parts[0]
        for part in parts[1:]:
            union = union.unionAll(part)
        for row in sorted(union.collect(), key=lambda r: (-r["count"], r["value"] or "")):
            found[row["name"]].append(row["value"])
    return found


def column_audit(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Nulls, non-nulls, rows and unique values (null counts as one) per column."""
    names = list(names or df.columns)
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0))
    return _per_column(df, names).agg(
        nulls.alias("null_records"),
        (F.sum("count") - nulls).alias("not_null_records"),
        F.sum("count").alias("total_count"),
        F.count_if(F.col("count") > 0).alias("unique_records"),
    )
