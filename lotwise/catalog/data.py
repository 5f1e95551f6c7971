"""The given tables seen as priced listings.

A listing is an order line with its part as the car, its order's priority as
the fuel and its supplier's nation as the region. Nulls are put in by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.plans.clean import CleanSpec

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fields() -> dict:
    line, order, part, supplier = (F.col(c) for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"))
    brand = F.substring("p_brand", 7, 3).cast("int")
    year = F.year("l_shipdate")
    return {
        **{k: F.col(k) for k in KEY},
        "price": F.floor("l_extendedprice").cast("int"),
        "odometer": (F.col("l_quantity") * 1000).cast("int"),
        "year": year,
        "manufacturer": F.col("p_brand"),
        "model": F.col("p_name"),
        "type": F.col("p_type"),
        "region": F.col("n_name"),
        "fuel": F.col("o_orderpriority"),
        "title_status": F.col("l_linestatus"),
        "transmission": F.col("l_returnflag"),
        "condition": F.when(part % 5 == 0, None).when(part % 3 == 0, "good").otherwise("fair"),
        "cylinders": F.when(supplier % 7 == 0, None).otherwise("6 cylinders"),
        "drive": F.when(order % 4 == 0, None).when(order % 3 == 0, "4wd").otherwise("fwd"),
        "paint_color": F.when(line == 3, None).when(line == 1, "red").otherwise("blue"),
        # A label the other columns explain: the price itself is noise.
        "worth": F.floor(
            1000 + 400 * F.col("l_quantity") - 900 * (2024 - year) + 150 * brand
            + 0.02 * F.col("l_extendedprice")
        ).cast("int"),
    }


PART = ("manufacturer", "model", "type", "worth")
ALL = (
    *KEY, "price", "odometer", "year", "manufacturer", "model", "type", "region", "fuel",
    "title_status", "transmission", "condition", "cylinders", "drive", "paint_color", "worth",
)


def listings(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Listings with the named columns, or all; joins only the tables they need.

    Every line has its part, order, supplier and nation, so a table left out
    changes no row. How each is joined is Spark's choice by size.
    """
    names = names or ALL
    rows = table(spark, sf_dir, "lineitem")
    if "fuel" in names:
        orders = table(spark, sf_dir, "orders")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if set(names) & set(PART):
        # After the orders, so that the texts of a part go through one shuffle less.
        part = table(spark, sf_dir, "part")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if "region" in names:
        # One table at a time: the size of a file is known, that of a join is guessed.
        supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fields = _fields()
    return rows.select(*[fields[n].alias(n) for n in names])


LISTINGS_SQL = """listings as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    cast(floor(l_extendedprice) as int) price, cast(l_quantity * 1000 as int) odometer,
    cast(year(l_shipdate) as int) "year", p_brand manufacturer, p_name model, p_type "type",
    n_name region, o_orderpriority fuel, l_linestatus title_status, l_returnflag transmission,
    case when l_partkey % 5 = 0 then null when l_partkey % 3 = 0 then 'good' else 'fair' end "condition",
    case when l_suppkey % 7 = 0 then null else '6 cylinders' end cylinders,
    case when l_orderkey % 4 = 0 then null when l_orderkey % 3 = 0 then '4wd' else 'fwd' end drive,
    case when l_linenumber = 3 then null when l_linenumber = 1 then 'red' else 'blue' end paint_color,
    cast(floor(1000 + 400 * l_quantity - 900 * (2024 - year(l_shipdate))
      + 150 * cast(substr(p_brand, 7) as int) + 2e-2 * l_extendedprice) as int) worth
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

# The same job as for vehicles, with values these tables have.
LISTINGS_SPEC = CleanSpec(
    drop=(*KEY, "url", "description"),
    makes=tuple(f"Brand#{i}" for i in range(1, 21)),
    transmissions=("A", "N"),
    top_k={"region": 5, "model": 50},
    year_after=1996,
    year_excluded=2001,
    reference_year=2024,
    rel_err=0.0,
)
MAKES_SQL = "(" + ", ".join(f"'{m}'" for m in LISTINGS_SPEC.makes) + ")"

COLUMNS_SQL = (
    'price, odometer, "year", manufacturer, model, "type", region, fuel, title_status, '
    'transmission, "condition", cylinders, drive, paint_color, worth'
)

CLEANED_SQL = f"""{LISTINGS_SQL},
deduped as (select distinct {COLUMNS_SQL} from listings),
present as (select * from deduped where region is not null and price is not null and "year" is not null
  and model is not null and odometer is not null and manufacturer is not null
  and transmission is not null and title_status is not null and fuel is not null),
top_region as (select region v from present group by region order by count(*) desc, region limit 5),
top_model as (select model v from present group by model order by count(*) desc, model limit 50),
grouped as (select price, odometer, "year",
    case when manufacturer in {MAKES_SQL} then manufacturer else 'others' end manufacturer,
    case when model in (select v from top_model) then model else 'others' end model,
    coalesce("type", 'unknown') "type",
    case when region in (select v from top_region) then region else 'others' end region,
    fuel, title_status, transmission, coalesce("condition", 'unknown') "condition",
    coalesce(cylinders, 'unknown') cylinders, coalesce(drive, 'unknown') drive,
    coalesce(paint_color, 'unknown') paint_color, worth
  from present),
allowed as (select * from grouped where transmission in ('A', 'N')),
price_q as (select quantile_disc(price, 0.15) lo, quantile_disc(price, 0.75) hi from allowed),
priced as (select a.* from allowed a, price_q where price > lo and price < hi + 1.5 * (hi - lo)),
odo_q as (select quantile_disc(odometer, 0.05) lower_end, quantile_disc(odometer, 0.25) lo,
    quantile_disc(odometer, 0.75) hi from priced),
driven as (select p.* from priced p, odo_q
  where odometer > lower_end and odometer < hi + 1.5 * (hi - lo)),
recent as (select * from driven where "year" > 1996),
dated as (select * from recent where "year" <> 2001),
cleaned as (select * exclude ("year"), 2024 - "year" as car_age from dated)"""
