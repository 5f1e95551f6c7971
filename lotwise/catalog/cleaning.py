"""Rare values, fences, year rules and the whole cleaning job."""

from __future__ import annotations

from lotwise.catalog.data import CLEANED_SQL, COLUMNS_SQL, LISTINGS_SPEC, LISTINGS_SQL, MAKES_SQL, listings
from lotwise.catalog.registry import query
from lotwise.operators import clean
from lotwise.plans import clean as job


@query(
    "group_rare_fixed",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber,
        case when manufacturer in {MAKES_SQL} then manufacturer else 'others' end manufacturer
        from listings""",
)
def group_rare_fixed(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "manufacturer")
    return clean.group_rare_fixed(df, "manufacturer", LISTINGS_SPEC.makes)


@query(
    "group_rare_topk",
    f"""with {LISTINGS_SQL},
        top as (select model v from listings group by model order by count(*) desc, model limit 50)
        select l_orderkey, l_linenumber,
          case when model in (select v from top) then model else 'others' end model from listings""",
)
def group_rare_topk(spark, sf):
    return clean.group_rare_topk(listings(spark, sf, "l_orderkey", "l_linenumber", "model"), "model", 50)


PRICED_SQL = f"""{LISTINGS_SQL},
  pq as (select quantile_disc(price, 0.15) lo, quantile_disc(price, 0.75) hi from listings),
  priced as (select listings.* from listings, pq where price > lo and price < hi + 1.5 * (hi - lo))"""


@query("trim_price", f"with {PRICED_SQL} select l_orderkey, l_linenumber, price from priced")
def trim_price(spark, sf):
    return clean.trim_price(listings(spark, sf, "l_orderkey", "l_linenumber", "price"), rel_err=0.0)


@query(
    "trim_odometer",
    f"""with {PRICED_SQL},
        oq as (select quantile_disc(odometer, 0.05) lower_end, quantile_disc(odometer, 0.25) lo,
          quantile_disc(odometer, 0.75) hi from priced)
        select l_orderkey, l_linenumber, price, odometer from priced, oq
        where odometer > lower_end and odometer < hi + 1.5 * (hi - lo)""",
)
def trim_odometer(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "price", "odometer")
    return clean.trim_odometer(clean.trim_price(df, rel_err=0.0), rel_err=0.0)


@query(
    "year_rules",
    f"""with {LISTINGS_SQL} select l_orderkey, l_linenumber, cast(2024 - "year" as int) car_age
        from listings where "year" > 1996 and "year" <> 2001""",
)
def year_rules(spark, sf):
    df = listings(spark, sf, "l_orderkey", "l_linenumber", "year")
    return clean.year_rules(df, after=1996, excluded=2001)


@query("clean_listings", f"with {CLEANED_SQL} select * from cleaned")
def clean_listings(spark, sf):
    return job.clean_listings(listings(spark, sf), LISTINGS_SPEC)


STEPS = (
    ("read", f"(select {COLUMNS_SQL} from listings)"),
    ("distinct", "deduped"),
    ("required present", "present"),
    ("transmission in list", "allowed"),
    ("price in fence", "priced"),
    ("odometer in fence", "driven"),
    ("year after minimum", "recent"),
    ("year not excluded", "dated"),
)


@query(
    "step_counts",
    f"with {CLEANED_SQL} "
    + " union all ".join(
        f"""select {i} pos, '{name}' step, count(*) "rows" from {source}"""
        for i, (name, source) in enumerate(STEPS)
    ),
)
def step_counts(spark, sf):
    return job.step_counts(listings(spark, sf), LISTINGS_SPEC)
