"""Duplicates, nulls, order and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Copies collapse in each task before the shuffle."""
    return df.distinct()


def drop_null_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop a row if any required column is null."""
    return df.na.drop(how="any", subset=list(required))


def fill_unknown(df: DataFrame, value: str = "unknown") -> DataFrame:
    """Replace null by ``value`` in string columns; other columns keep theirs."""
    return df.na.fill(value)


def sort_desc(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """Order by a column, largest first, equal values by ``ties`` ascending."""
    return df.orderBy(F.col(name).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])


def limit_n(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
