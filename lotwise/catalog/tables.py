"""Sources, sinks and small frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.catalog.data import LISTINGS_SQL, listings, table
from lotwise.catalog.registry import query
from lotwise.functions.columns import car_age, round_columns
from lotwise.operators.evaluate import regression_metrics
from lotwise.operators.profile import value_tallies
from lotwise.sources import frames
from lotwise.sources.csv import read_csv, read_csv_checked, write_csv
from lotwise.sources.workspace import new_path

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "read_csv",
    """select cast(o_orderkey as int) o_orderkey, cast(o_custkey as int) o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority from orders""",
)
def read_with_inferred_types(spark, sf):
    """Numbers, texts and dates get their types back from text."""
    path = new_path(spark, "orders-csv")
    write_csv(table(spark, sf, "orders"), path)
    return read_csv(spark, path)


@query(
    "read_csv_checked",
    """select o_orderpriority, count(*) "rows", count_if(o_orderkey % 10 <> 3 and o_orderkey % 10 <> 7) good,
       count_if(o_orderkey % 10 = 3 or o_orderkey % 10 = 7) corrupt from orders group by o_orderpriority""",
)
def read_with_corrupt_lines(spark, sf):
    """Lines with a broken quote or a cell too many are kept aside, and no line is lost."""
    orders = table(spark, sf, "orders")
    cells = [F.col(c).cast("string") for c in orders.columns]
    line = F.concat_ws(",", *cells)
    key = F.col("o_orderkey") % 10
    broken = F.when(key == 3, F.concat(F.lit('"'), line)).when(key == 7, F.concat(line, F.lit(",more"))).otherwise(line)
    path = new_path(spark, "orders-lines")
    orders.select(broken.alias("value")).write.text(path)
    good, corrupt = read_csv_checked(spark, path, orders.schema)
    priority = F.regexp_extract("_corrupt", "([0-9]-[A-Z ]+)", 1)
    both = good.select("o_orderpriority", F.lit(1).alias("good")).unionAll(corrupt.select(priority, F.lit(0)))
    return both.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"), F.count_if(F.col("good") == 0).alias("corrupt")
    )


@query("write_csv", "select doc_id, text, lang, source, n_chars from documents")
def write_and_read_free_text(spark, sf):
    """Texts with quotes, commas and line breaks come back as they were."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = new_path(spark, "documents-csv")
    write_csv(documents, path)
    return read_csv(spark, path, documents.schema, multi_line=True)


# Predictions without a model: a constant rate per unit, with and without the discount.
RATES = {"Flat": "l_quantity * 2000", "Discounted": "l_quantity * 2000 * (1 - l_discount)"}


@query(
    "rows_to_df",
    "with "
    + ", ".join(f"{n} as (select l_extendedprice y, {e} p from lineitem)" for n, e in RATES.items())
    + " "
    + " union all ".join(
        f"""select '{n}' "Model", round(1 - avg((y - p) * (y - p)) / var_pop(y), 2) "R2",
        round(avg((y - p) * (y - p)), 0) "Mse", round(avg(abs(y - p)), 4) "Mae",
        round(sqrt(avg((y - p) * (y - p))), 4) "Rmse" from {n}"""
        for n in RATES
    ),
)
def rows_to_df(spark, sf):
    line = table(spark, sf, "lineitem")
    rows = []
    for name, rate in RATES.items():
        scored = line.select("l_extendedprice", F.expr(rate).alias("prediction"))
        scores = regression_metrics(scored, "l_extendedprice").first()
        rows.append((name, scores["R2"], scores["Mse"], scores["Mae"], scores["Rmse"]))
    table_of_scores = frames.rows_to_df(spark, rows, frames.METRIC_SCHEMA)
    return round_columns(table_of_scores, {"R2": 2, "Mse": 0, "Mae": 4, "Rmse": 4})


CATEGORIES = frames.REQUEST_SCHEMA.names[2:]


@query(
    "request_to_df",
    f"""with {LISTINGS_SQL} select (select round(avg(2024 - "year"), 4) from listings) car_age,
        (select round(avg(odometer), 4) from listings) odometer, """
    + ", ".join(
        f"""(select "{c}" from listings where "{c}" is not null group by "{c}"
             order by count(*) desc, "{c}" limit 1) "{c}" """
        for c in CATEGORIES
    ),
)
def request_to_df(spark, sf):
    """A request for the most usual listing."""
    rows = car_age(listings(spark, sf, "odometer", "year"))
    numbers = rows.agg(F.avg("car_age").alias("car_age"), F.avg("odometer").alias("odometer")).first()
    tallies = value_tallies(listings(spark, sf, *CATEGORIES)).where(F.col("value").isNotNull())
    first = F.min(F.struct((-F.col("count")).alias("n"), "value"))["value"]
    usual = {r["column_name"]: r["value"] for r in tallies.groupBy("column_name").agg(first.alias("value")).collect()}
    request = frames.request_to_df(spark, **numbers.asDict(), **usual)
    return round_columns(request, {"car_age": 4, "odometer": 4})


@query("preview", f"select {', '.join(ORDER_COLUMNS)} from orders order by o_orderkey limit 5")
def preview(spark, sf):
    return frames.preview(table(spark, sf, "orders").select(*ORDER_COLUMNS), 5, order_by=("o_orderkey",))


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "schema_table",
    "with kinds(duck, kind) as (values ('BIGINT', 'bigint'), ('INTEGER', 'int'), ('DOUBLE', 'double'), "
    "('VARCHAR', 'string'), ('TIMESTAMP', 'timestamp_ntz')), "
    "described as (select row_number() over () - 1 pos, column_name, column_type, \"null\" n "
    "from (describe lineitem)), "
    "seen as ("
    + " union all ".join(
        f"select '{c}' c, count(*) r, count(*) filter ({c} is null) z from lineitem" for c in LINE_COLUMNS
    )
    + """) select cast(pos as int) pos, column_name "name", kind "type", n = 'YES' nullable, r "rows", z nulls
    from described join kinds on duck = column_type join seen on c = column_name""",
)
def schema_table(spark, sf):
    return frames.schema_table(table(spark, sf, "lineitem"), with_nulls=True)
