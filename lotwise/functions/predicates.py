"""Row filters. A null never passes a comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_is_null(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNull())


def filter_not_null(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull())


def filter_in_list(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.where(F.col(name).isin(list(values)))


def filter_open_range(df: DataFrame, name: str, low, high) -> DataFrame:
    """Keep ``low < name < high``, both ends excluded."""
    return df.where((F.col(name) > F.lit(low)) & (F.col(name) < F.lit(high)))


def filter_greater(df: DataFrame, name: str, bound) -> DataFrame:
    return df.where(F.col(name) > F.lit(bound))


def filter_not_equal(df: DataFrame, name: str, value) -> DataFrame:
    return df.where(F.col(name) != F.lit(value))
