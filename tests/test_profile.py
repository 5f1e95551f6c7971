from __future__ import annotations

import pandas as pd

from lotwise.operators import profile as P


def frame(spark):
    rows = [("a", 1, None), ("a", 2, None), ("b", 2, 1.5), (None, 3, 1.5), ("c", None, 2.5)]
    return spark.createDataFrame(rows, "s string, n int, x double")


def test_counts(spark):
    df = frame(spark)
    assert P.row_count(df).first()[0] == 5
    assert tuple(P.null_counts(df).first()) == (1, 1, 2)
    row = P.null_percentages(df).first()
    assert row.asDict() == {"s_null_percentage": 20.0, "n_null_percentage": 20.0, "x_null_percentage": 40.0}


def test_counts_of_an_empty_table(spark):
    empty = frame(spark).limit(0)
    assert P.row_count(empty).first()[0] == 0
    assert tuple(P.null_counts(empty).first()) == (0, 0, 0)
    assert tuple(P.null_percentages(empty).first()) == (None, None, None)
    assert P.value_counts(empty, "s").count() == 0
    assert P.unique_values_count(empty, "s").first()[0] == 0
    assert {r.unique_records for r in P.column_audit(empty).collect()} == {0}


def test_distinct_skips_null_and_unique_counts_it(spark):
    df = frame(spark)
    assert {r[0]: r[1] for r in P.distinct_counts(df).collect()} == {"s": 3, "n": 3, "x": 2}
    assert P.unique_values_count(df, "s").first()[0] == 4
    sketched = {r[0]: r[1] for r in P.distinct_counts(df, rsd=0.01).collect()}
    assert sketched == {"s": 3, "n": 3, "x": 2}


def test_value_counts_has_a_null_group(spark):
    assert {(r[0], r[1]) for r in P.value_counts(frame(spark), "s").collect()} == {
        ("a", 2), ("b", 1), ("c", 1), (None, 1),
    }


def test_column_audit_is_the_five_facts(spark):
    audit = {r.column_name: tuple(r)[1:] for r in P.column_audit(frame(spark)).collect()}
    assert audit == {"s": (1, 4, 5, 4), "n": (1, 4, 5, 4), "x": (2, 3, 5, 3)}


def test_column_audit_scans_the_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark).write.parquet(path)
    plan = P.column_audit(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_values_equal_as_values_count_once(spark):
    df = spark.sql(
        "select * from values (0.0D, timestamp'2024-01-01 00:00:00.000001', true), "
        "(-0.0D, timestamp'2024-01-01 00:00:00.000002', false), "
        "(double('NaN'), null, true), (double('NaN'), null, null) as t(x, ts, flag)"
    )
    assert {r[0]: r[1] for r in P.distinct_counts(df).collect()} == {"x": 2, "ts": 2, "flag": 2}


def test_top_k_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbccdde"], "v string")
    assert [tuple(r) for r in P.top_k_values(df, "v", 3).collect()] == [("a", 3), ("b", 2), ("c", 2)]
    assert P.top_values(df, {"v": 3}) == {"v": ["a", "b", "c"]}


def test_top_k_does_not_depend_on_partitions(spark, vehicles):
    whole = [tuple(r) for r in P.top_k_values(vehicles, "model", 50).collect()]
    apart = [tuple(r) for r in P.top_k_values(vehicles.repartition(7), "model", 50).collect()]
    assert whole == apart


def test_a_hot_value_is_counted_in_full(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as v")
    counts = P.value_counts(df, "v").toPandas().set_index("v")["count"]
    assert counts["hot"] == 10000 and len(counts) == 20001
    assert isinstance(counts, pd.Series)
