"""Counts, quantiles and top values."""

from __future__ import annotations

from lotwise.catalog.data import LISTINGS_SQL, listings, table
from lotwise.catalog.registry import query
from lotwise.operators import profile
from lotwise.operators.quantiles import approx_quantiles
from lotwise.operators.rows import limit_n, sort_desc

PROFILED = (
    "price", "odometer", "year", "manufacturer", "model", "type", "region", "fuel", "title_status",
    "transmission", "condition", "cylinders", "drive", "paint_color",
)


@query("row_count", 'select count(*) "rows" from lineitem')
def row_count(spark, sf):
    return profile.row_count(table(spark, sf, "lineitem"))


@query(
    "null_counts",
    f"with {LISTINGS_SQL} select "
    + ", ".join(f'count(*) filter ("{c}" is null) "{c}"' for c in PROFILED)
    + " from listings",
)
def null_counts(spark, sf):
    return profile.null_counts(listings(spark, sf, *PROFILED))


@query(
    "null_percentages",
    f"with {LISTINGS_SQL} select "
    + ", ".join(f'count(*) filter ("{c}" is null) / count(*) * 100 "{c}_null_percentage"' for c in PROFILED)
    + " from listings",
)
def null_percentages(spark, sf):
    return profile.null_percentages(listings(spark, sf, *PROFILED))


@query(
    "distinct_counts",
    f"with {LISTINGS_SQL} "
    + " union all ".join(
        f"""select '{c}' column_name, count(distinct "{c}") distinct_values from listings""" for c in PROFILED
    ),
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(listings(spark, sf, *PROFILED))


@query(
    "unique_values_count",
    f"""with {LISTINGS_SQL}, d as (select distinct "condition" from listings)
        select count(*) unique_records from d""",
)
def unique_values_count(spark, sf):
    return profile.unique_values_count(listings(spark, sf, "condition"), "condition")


@query(
    "value_counts",
    f"""with {LISTINGS_SQL} select "condition", count(*) "count" from listings group by "condition" """,
)
def value_counts(spark, sf):
    return profile.value_counts(listings(spark, sf, "condition"), "condition")


AUDITED = (
    "manufacturer", "region", "model", "transmission", "drive", "year", "odometer", "price",
    "condition", "cylinders",
)


@query(
    "column_audit",
    f"with {LISTINGS_SQL} "
    + " union all ".join(
        f"""select '{c}' column_name, count(*) filter ("{c}" is null) null_records,
        count("{c}") not_null_records, count(*) total_count,
        count(distinct "{c}") + max(case when "{c}" is null then 1 else 0 end) unique_records
        from listings"""
        for c in AUDITED
    ),
)
def column_audit(spark, sf):
    return profile.column_audit(listings(spark, sf, *AUDITED))


QUANTILES = {"l_extendedprice": (0.15, 0.75), "l_quantity": (0.05, 0.25, 0.75)}


@query(
    "approx_quantiles",
    " union all ".join(
        f"""select '{c}' column_name, cast({p} as double) probability,
        cast(quantile_disc({c}, {p}) as double) "value" from lineitem"""
        for c, ps in QUANTILES.items()
        for p in ps
    ),
)
def quantiles_exact(spark, sf):
    return approx_quantiles(table(spark, sf, "lineitem"), QUANTILES, rel_err=0.0)


@query(
    "top_k_values",
    "select p_name, count(*) \"count\" from part group by p_name order by count(*) desc, p_name limit 50",
)
def top_k_values(spark, sf):
    return profile.top_k_values(table(spark, sf, "part"), "p_name", 50)


@query(
    "sort_desc",
    'select p_name, count(*) "count" from part group by p_name order by count(*) desc, p_name',
)
def sort_descending(spark, sf):
    return sort_desc(profile.value_counts(table(spark, sf, "part"), "p_name"), "count", "p_name")


@query(
    "limit_n",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
       order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 50""",
)
def limit_rows(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return limit_n(sort_desc(df, "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"), 50)
