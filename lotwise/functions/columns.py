"""Projections and column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Remove named columns; absent names are ignored."""
    return df.drop(*names)


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def int_or_null(name: str, kind: T.DataType) -> Column:
    """``name`` as int; malformed text and out-of-range numbers become null."""
    value = F.col(name)
    if isinstance(kind, T.StringType):
        value = value.try_cast("double")
    return value.try_cast("int")


def cast_int(df: DataFrame, *names: str) -> DataFrame:
    """Replace each column by its integer part, null where there is none."""
    return df.withColumns({n: int_or_null(n, df.schema[n].dataType) for n in names})


def bool_to_int(predicate: Column) -> Column:
    return predicate.cast("int")


def car_age(df: DataFrame, reference_year: int = 2024, year: str = "year") -> DataFrame:
    """Add ``car_age`` counted from ``reference_year`` and drop the year."""
    return df.withColumn("car_age", F.lit(reference_year) - F.col(year)).drop(year)


def percent_of_total(part: Column, total: Column) -> Column:
    """``part / total * 100``; null when the total is zero."""
    return part / F.nullif(total, F.lit(0)) * 100


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round columns half up to the digits given; other columns pass through."""
    return df.select(
        *[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


def case_when(predicate: Column, value: Column, otherwise: str = "others") -> Column:
    """``value`` where the predicate holds; a null predicate does not hold."""
    return F.when(predicate, value).otherwise(F.lit(otherwise))


def int_price_text(price: Column, prefix: str = "Your Car Price is $") -> Column:
    """Price without its fraction, as text after ``prefix``."""
    return F.concat(F.lit(prefix), price.try_cast("bigint").cast("string"))


def hash_text(seed: int, names: Sequence[str]) -> Column:
    """32 hex digits that depend on the seed and the named values only.

    Unlike a random column it does not change with the partitioning, with a
    re-run task or with a lost executor.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))
