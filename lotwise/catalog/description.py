"""Histograms, boxes, group means, correlations, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.catalog.data import KEY, LISTINGS_SQL, listings, table
from lotwise.catalog.registry import query
from lotwise.functions.columns import car_age, round_columns
from lotwise.operators import describe
from lotwise.operators.clean import trim_price


def _histogram_sql(source: str, name: str, bins: int) -> str:
    return f"""seen as (select cast({name} as double) x from {source} where {name} is not null),
    ends as (select min(x) lo, max(x) hi, (max(x) - min(x)) / {bins} width from seen),
    counted as (select cast(least(floor((x - lo) / width), {bins - 1}) as int) bin, count(*) n
      from seen, ends group by 1)
    select cast(b.bin as int) bin, round(lo + b.bin * width, 4) low, round(lo + (b.bin + 1) * width, 4) high,
      coalesce(n, 0) n
    from range({bins}) b(bin) left join counted on b.bin = counted.bin, ends"""


@query("histogram", f"with {LISTINGS_SQL}, {_histogram_sql('listings', 'price', 20)}")
def histogram(spark, sf):
    df = describe.histogram(listings(spark, sf, "price"), "price", 20)
    return round_columns(df, {"low": 4, "high": 4})


@query(
    "histogram_trimmed",
    f"""with {LISTINGS_SQL},
      pq as (select quantile_disc(price, 0.15) lo, quantile_disc(price, 0.75) hi from listings),
      priced as (select listings.* from listings, pq where price > lo and price < hi + 1.5 * (hi - lo)),
      {_histogram_sql('priced', 'odometer', 30)}""",
)
def histogram_trimmed(spark, sf):
    df = trim_price(listings(spark, sf, "price", "odometer"), rel_err=0.0)
    return round_columns(describe.histogram(df, "odometer", 30), {"low": 4, "high": 4})


@query(
    "box_stats",
    """with q as (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) median,
          quantile_cont(l_extendedprice, 0.75) q3 from lineitem)
       select round(q1, 4) q1, round(median, 4) median, round(q3, 4) q3,
         least(min(l_extendedprice) filter (l_extendedprice >= q1 - 1.5 * (q3 - q1)), q1) whisker_low,
         greatest(max(l_extendedprice) filter (l_extendedprice <= q3 + 1.5 * (q3 - q1)), q3) whisker_high,
         count(*) filter (l_extendedprice < q1 - 1.5 * (q3 - q1) or l_extendedprice > q3 + 1.5 * (q3 - q1)) outliers,
         count(l_extendedprice) n
       from lineitem, q group by q1, median, q3""",
)
def box_stats(spark, sf):
    df = describe.box_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    return round_columns(df, {"q1": 4, "median": 4, "q3": 4})


def _means_sql(*by: str) -> str:
    keys = ", ".join(f'"{b}"' for b in by)
    return f"""select {keys}, count(price) n, round(avg(price), 4) mean,
      round(avg(price) - 1.96 * stddev_samp(price) / sqrt(count(price)), 4) ci_low,
      round(avg(price) + 1.96 * stddev_samp(price) / sqrt(count(price)), 4) ci_high
      from listings group by {keys}"""


ROUNDED = {"mean": 4, "ci_low": 4, "ci_high": 4}


def _mean_query(by: str):
    source = """, listings_ as (select *, cast(2024 - "year" as int) car_age from listings) """
    sql = _means_sql(by).replace("from listings", "from listings_")

    @query(f"group_mean_ci_{by}", f"with {LISTINGS_SQL}{source}{sql}")
    def build(spark, sf):
        df = listings(spark, sf, "price", "year" if by == "car_age" else by)
        df = car_age(df) if by == "car_age" else df
        return round_columns(describe.group_mean_ci(df, by), ROUNDED)


for _by in ("odometer", "fuel", "condition", "car_age"):
    _mean_query(_by)


@query("group_mean_ci", f"with {LISTINGS_SQL} {_means_sql('year')}")
def group_mean_ci(spark, sf):
    return round_columns(describe.group_mean_ci(listings(spark, sf, "price", "year"), "year"), ROUNDED)


DRAWS = 96
_TIMES = " + ".join(f"(u >= {t})::int" for t in describe.POISSON if t < 65536)


@query(
    "group_mean_bootstrap",
    f"""with {LISTINGS_SQL},
      drawn as (select fuel, price, b, ('0x' || substr(md5(concat_ws('|', '23', b // 8, {', '.join(KEY)})), 4 * (b % 8) + 1, 4))::int u
        from listings, range({DRAWS}) r(b)),
      means as (select fuel, b, sum(price * ({_TIMES})) / sum({_TIMES}) m from drawn group by fuel, b),
      bounds as (select fuel, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi from means group by fuel)
      select fuel, count(*) n, round(avg(price), 4) mean, round(any_value(lo), 4) ci_low, round(any_value(hi), 4) ci_high
      from listings join bounds using (fuel) group by fuel""",
)
def group_mean_bootstrap(spark, sf):
    df = listings(spark, sf, *KEY, "price", "fuel")
    return round_columns(describe.group_mean_bootstrap(df, "fuel", KEY, draws=DRAWS), ROUNDED)


@query("group_mean_2d", f"with {LISTINGS_SQL} {_means_sql('fuel', 'condition')}")
def group_mean_2d(spark, sf):
    df = listings(spark, sf, "price", "fuel", "condition")
    return round_columns(describe.group_mean_2d(df, "fuel", "condition"), ROUNDED)


CORRELATED = ("price", "car_age", "odometer", "worth")


@query(
    "correlation_matrix",
    f"""with {LISTINGS_SQL}, aged as (select *, 2024 - "year" car_age from listings) """
    + " union all ".join(
        f"select '{a}' x_col, '{b}' y_col, round(corr({a}, {b}), 6) r from aged"
        for a in CORRELATED
        for b in CORRELATED
    ),
)
def correlation_matrix(spark, sf):
    df = listings(spark, sf, "price", "year", "odometer", "worth")
    df = df.withColumn("car_age", 2024 - F.col("year"))
    return round_columns(describe.correlation_matrix(df, CORRELATED), {"r": 6})


SAMPLE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "odometer")
SAMPLE_SQL = f"""sampled as (select {', '.join(SAMPLE_KEY)} from listings
  order by md5(concat_ws('|', '23', {', '.join(SAMPLE_KEY)})), {', '.join(SAMPLE_KEY)} limit 100)"""


@query("sample_n", f"with {LISTINGS_SQL}, {SAMPLE_SQL} select * from sampled")
def sample_n(spark, sf):
    return describe.sample_n(listings(spark, sf, *SAMPLE_KEY), 100)


@query(
    "pair_plot_data",
    f"with {LISTINGS_SQL}, {SAMPLE_SQL} "
    + " union all ".join(
        f"select '{a}' x_col, '{b}' y_col, cast({a} as double) x, cast({b} as double) y from sampled"
        for a in ("price", "odometer")
        for b in ("price", "odometer")
    ),
)
def pair_plot_data(spark, sf):
    return describe.pair_plot_data(listings(spark, sf, *SAMPLE_KEY), ("price", "odometer"), 100)
