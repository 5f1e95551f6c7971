"""Rare values, outlier fences and year rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.columns import car_age, case_when
from lotwise.functions.predicates import filter_greater, filter_not_equal, filter_open_range
from lotwise.operators.profile import top_k_values
from lotwise.operators.quantiles import quantiles

OTHERS = "others"


def group_rare_fixed(df: DataFrame, name: str, keep: Sequence, other: str = OTHERS) -> DataFrame:
    """Keep listed values; everything else, null included, becomes ``other``."""
    return df.withColumn(name, case_when(F.col(name).isin(list(keep)), F.col(name), other))


def group_rare_topk(df: DataFrame, name: str, k: int, other: str = OTHERS) -> DataFrame:
    """Keep the ``k`` most frequent values, the rest becomes ``other``.

    ``df`` is read twice, once for one column. The list holds at most ``k`` rows
    and is joined back: Spark broadcasts it below its threshold, and beyond that
    adaptive execution splits a hot value on the left.
    """
    return keep_listed(df, name, top_k_values(df, name, k), other)


def keep_listed(df: DataFrame, name: str, listed: DataFrame, other: str = OTHERS) -> DataFrame:
    """Keep the values of the column ``name`` of ``listed``, each there once; the rest becomes ``other``."""
    kept = listed.select(F.col(name).alias("_kept"))
    joined = df.join(kept, F.col(name) == F.col("_kept"), "left")
    return joined.select(
        *[
            F.coalesce(F.col("_kept"), F.lit(other)).alias(c) if c == name else F.col(c)
            for c in df.columns
        ]
    )


def quantile_fence(
    df: DataFrame,
    name: str,
    lower: float,
    q_lo: float,
    q_hi: float,
    k: float = 1.5,
    rel_err: float = 0.01,
) -> tuple[float, float] | None:
    """``(P_lower, P_hi + k * (P_hi - P_lo))``; None when there is no value."""
    p_lower, p_lo, p_hi = quantiles(df, name, [lower, q_lo, q_hi], rel_err)
    if p_hi is None:
        return None
    return p_lower, p_hi + k * (p_hi - p_lo)


def trim_by_quantile(
    df: DataFrame,
    name: str,
    lower: float,
    q_lo: float,
    q_hi: float,
    k: float = 1.5,
    rel_err: float = 0.01,
) -> DataFrame:
    """Keep rows strictly inside the fence; the fence reaches the scan as literals."""
    fence = quantile_fence(df, name, lower, q_lo, q_hi, k, rel_err)
    return df.where(F.lit(False)) if fence is None else filter_open_range(df, name, *fence)


def trim_price(df: DataFrame, name: str = "price", rel_err: float = 0.01) -> DataFrame:
    """Fence P15 and P75; its spread is P75 - P15, not the interquartile range."""
    return trim_by_quantile(df, name, lower=0.15, q_lo=0.15, q_hi=0.75, rel_err=rel_err)


def trim_odometer(df: DataFrame, name: str = "odometer", rel_err: float = 0.01) -> DataFrame:
    """Fence P5 and P75 + 1.5 interquartile ranges."""
    return trim_by_quantile(df, name, lower=0.05, q_lo=0.25, q_hi=0.75, rel_err=rel_err)


def year_rules(
    df: DataFrame,
    after: int = 1996,
    excluded: int = 2022,
    reference_year: int = 2024,
    year: str = "year",
) -> DataFrame:
    """Keep years after ``after`` other than ``excluded`` and turn them into ages."""
    kept = filter_not_equal(filter_greater(df, year, after), year, excluded)
    return car_age(kept, reference_year, year)
