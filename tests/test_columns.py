from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import columns as C
from lotwise.functions import predicates as P
from lotwise.operators import rows as R


def values(df, name):
    return [r[name] for r in df.collect()]


def test_cast_int_takes_the_integer_part_and_nulls_what_is_no_number(spark):
    texts = ["2012", "2012.0", "2012.9", "-3.7", " 7 ", "x", "", None, "99999999999", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    assert values(C.cast_int(df, "a"), "a") == [2012, 2012, 2012, -3, 7, None, None, None, None, None]


def test_cast_int_of_numbers(spark):
    df = spark.createDataFrame([(1.9, 3), (-1.9, None), (1e12, 5)], "a double, b bigint")
    cast = C.cast_int(df, "a", "b")
    assert [tuple(r) for r in cast.collect()] == [(1, 3), (-1, None), (None, 5)]
    assert [f.dataType.simpleString() for f in cast.schema] == ["int", "int"]


def test_car_age_replaces_year(spark):
    df = spark.createDataFrame([(2012, 1), (None, 2)], "year int, k int")
    aged = C.car_age(df, 2024)
    assert aged.columns == ["k", "car_age"]
    assert values(aged, "car_age") == [12, None]


def test_drop_columns_ignores_absent_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.drop_columns(df, "b", "nothing").columns == ["a"]


def test_percent_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "a int, n int")
    assert values(df.select(C.percent_of_total(F.col("a"), F.col("n")).alias("p")), "p") == [25.0, None]


def test_round_columns_keeps_order_and_other_columns(spark):
    df = spark.createDataFrame([("m", 0.125, 2.00005)], "Model string, R2 double, Mse double")
    rounded = C.round_columns(df, {"Mse": 4, "R2": 2})
    assert rounded.columns == ["Model", "R2", "Mse"]
    assert tuple(rounded.first()) == ("m", 0.13, 2.0001)


def test_case_when_null_goes_to_otherwise(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert values(df.select(C.case_when(F.col("v") == "a", F.col("v")).alias("v")), "v") == ["a", "others", "others"]


def test_int_price_text(spark):
    df = spark.createDataFrame([(1234.99,), (-0.5,), (3e10,), (None,), (float("nan"),)], "p double")
    assert values(df.select(C.int_price_text(F.col("p")).alias("t")), "t") == [
        "Your Car Price is $1234", "Your Car Price is $0", "Your Car Price is $30000000000", None, None,
    ]


def test_filters_drop_null(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    assert values(P.filter_is_null(df, "a"), "a") == [None]
    assert values(P.filter_not_null(df, "a"), "a") == [1, 2, 3]
    assert values(P.filter_in_list(df, "a", [1, 3, 9]), "a") == [1, 3]
    assert values(P.filter_open_range(df, "a", 1, 3), "a") == [2]
    assert values(P.filter_greater(df, "a", 2), "a") == [3]
    assert values(P.filter_not_equal(df, "a", 2), "a") == [1, 3]


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "s string, n int")
    assert R.drop_null_rows(df, ["s"]).count() == 2
    assert R.drop_null_rows(df, ["s", "n"]).count() == 1
    filled = R.fill_unknown(df)
    assert [tuple(r) for r in filled.collect()] == [("a", 1), ("unknown", 2), ("b", None)]
    assert filled.exceptAll(R.fill_unknown(filled)).isEmpty()


def test_drop_duplicates_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None)] * 5 + [("a", 1), (None, None), (None, None)], "s string, n int")
    once = R.drop_duplicates(df)
    assert once.count() == 3
    assert R.drop_duplicates(once).count() == 3


def test_sort_desc_breaks_ties_ascending(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", None)], "v string, n int")
    assert values(R.sort_desc(df, "n", "v"), "v") == ["c", "a", "b", "d"]
    assert values(R.limit_n(R.sort_desc(df, "n", "v"), 2), "v") == ["c", "a"]


def test_filters_and_columns_reach_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id as price", "id * 2 as year", "cast(id as string) as text").write.parquet(path)
    df = P.filter_greater(spark.read.parquet(path), "year", 50).select("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(year,50)" in plan
    assert "text" not in plan.split("ReadSchema")[1]
