"""Projections, expressions, filters, null rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.catalog.data import LISTINGS_SQL, listings, table
from lotwise.catalog.registry import query
from lotwise.functions import columns as C
from lotwise.functions import predicates as P
from lotwise.operators import rows as R
from lotwise.operators.score import validate_domains as count_violations


@query("drop_columns", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def drop_columns(spark, sf):
    return C.drop_columns(
        table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
        "l_tax", "l_linestatus", "l_shipdate", "no_such_column",
    )


@query("select_columns", f"""with {LISTINGS_SQL} select price, "year" from listings""")
def select_columns(spark, sf):
    return C.select_columns(listings(spark, sf, "price", "odometer", "year"), "price", "year")


@query(
    "cast_int",
    """select l_orderkey, l_linenumber, cast(l_shipdate_year as int) as "year",
         cast(trunc(l_quantity) as int) as odometer, cast(trunc(l_extendedprice) as int) as price,
         cast(trunc(try_cast(l_returnflag as double)) as int) as malformed
       from (select *, year(l_shipdate) l_shipdate_year from lineitem)""",
)
def cast_int(spark, sf):
    text = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.year("l_shipdate").cast("string").alias("year"),
        F.col("l_quantity").cast("string").alias("odometer"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("l_returnflag").alias("malformed"),
    )
    return C.cast_int(text, "year", "odometer", "price", "malformed")


@query(
    "bool_to_int",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber, cast("condition" is null as int) no_condition,
        cast(drive is null as int) no_drive from listings""",
)
def bool_to_int(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "condition", "drive")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        C.bool_to_int(F.col("condition").isNull()).alias("no_condition"),
        C.bool_to_int(F.col("drive").isNull()).alias("no_drive"),
    )


@query(
    "car_age",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber, cast(2024 - "year" as int) car_age from listings""",
)
def car_age(spark, sf):
    return C.car_age(listings(spark, sf, "l_orderkey", "l_linenumber", "year"))


@query(
    "percent_of_total",
    """select l_returnflag, count(*) / sum(count(*)) over () * 100 as row_percentage
       from lineitem group by l_returnflag""",
)
def percent_of_total(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf, "lineitem").agg(F.count(F.lit(1))).scalar()
    return counts.select("l_returnflag", C.percent_of_total(F.col("n"), total).alias("row_percentage"))


@query(
    "round_columns",
    """select l_orderkey, l_linenumber, round(l_extendedprice, 1) l_extendedprice, round(l_quantity, 0) l_quantity
       from lineitem""",
)
def round_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return C.round_columns(df, {"l_extendedprice": 1, "l_quantity": 0})


@query(
    "case_when",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber,
          case when drive = '4wd' then drive else 'others' end drive from listings""",
)
def case_when(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "drive")
    return df.withColumn("drive", C.case_when(F.col("drive") == "4wd", F.col("drive")))


@query(
    "int_price_text",
    """select l_orderkey, l_linenumber,
         'Your Car Price is $' || cast(cast(trunc(l_extendedprice) as bigint) as varchar) price_text
       from lineitem""",
)
def int_price_text(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.int_price_text(F.col("l_extendedprice")).alias("price_text")
    )


NARROW = ("l_orderkey", "l_linenumber", "price", "year", "transmission", "drive")
FROM_LISTINGS = f"""with {LISTINGS_SQL}
  select l_orderkey, l_linenumber, price, "year", transmission, drive from listings where """


@query("filter_is_null", FROM_LISTINGS + "drive is null")
def filter_is_null(spark, sf):
    return P.filter_is_null(listings(spark, sf, *NARROW), "drive")


@query("filter_not_null", FROM_LISTINGS + "drive is not null")
def filter_not_null(spark, sf):
    return P.filter_not_null(listings(spark, sf, *NARROW), "drive")


@query("filter_in_list", FROM_LISTINGS + "transmission in ('A', 'N', 'unknown')")
def filter_in_list(spark, sf):
    return P.filter_in_list(listings(spark, sf, *NARROW), "transmission", ["A", "N", "unknown"])


@query("filter_open_range", FROM_LISTINGS + "price > 20000 and price < 50000")
def filter_open_range(spark, sf):
    return P.filter_open_range(listings(spark, sf, *NARROW), "price", 20000, 50000)


@query("filter_greater", FROM_LISTINGS + '"year" > 1996')
def filter_greater(spark, sf):
    return P.filter_greater(listings(spark, sf, *NARROW), "year", 1996)


@query("filter_not_equal", FROM_LISTINGS + "drive <> 'fwd'")
def filter_not_equal(spark, sf):
    return P.filter_not_equal(listings(spark, sf, *NARROW), "drive", "fwd")


@query("drop_duplicates", "select distinct text, lang from documents")
def drop_duplicates(spark, sf):
    return R.drop_duplicates(table(spark, sf, "documents").select("text", "lang"))


@query(
    "drop_null_rows",
    """select d.doc_id, lang, quality from documents d left join labels l on d.doc_id = l.doc_id
       where lang is not null and quality is not null""",
)
def drop_null_rows(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.drop_null_rows(labelled.select("doc_id", "lang", "quality"), ["lang", "quality"])


@query(
    "fill_unknown",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber, coalesce("condition", 'unknown') "condition",
        coalesce(cylinders, 'unknown') cylinders, coalesce(drive, 'unknown') drive,
        case when price % 2 = 0 then price end price from listings""",
)
def fill_unknown(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "condition", "cylinders", "drive", "price")
    return R.fill_unknown(df.withColumn("price", F.when(F.col("price") % 2 == 0, F.col("price"))))


ALLOWED = {
    "condition": ("good", "unknown"),
    "fuel": ("1-URGENT", "2-HIGH", "3-MEDIUM"),
    "drive": ("fwd", "4wd", "unknown"),
    "paint_color": ("red", "unknown"),
}


def _violations_sql(name: str, values: tuple) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"""select '{name}' column_name, count(*) "rows",
      count(*) filter ("{name}" is null or "{name}" not in ({listed})) violations from listings"""


@query(
    "validate_domains",
    f"with {LISTINGS_SQL} " + " union all ".join(_violations_sql(n, v) for n, v in ALLOWED.items()),
)
def validate_domains(spark, sf):
    return count_violations(listings(spark, sf, *ALLOWED), ALLOWED)
