from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lotwise.operators import describe as D


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)
    n = 500
    return pd.DataFrame(
        {
            "price": rng.gamma(2.0, 9000.0, n).round(2),
            "odometer": rng.integers(0, 200000, n),
            "fuel": rng.choice(["gas", "diesel", "electric"], n, p=[0.8, 0.19, 0.01]),
            "condition": rng.choice(["good", "fair"], n),
        }
    )


def test_histogram_is_numpy_s(spark, numbers):
    got = D.histogram(spark.createDataFrame(numbers), "price", 20).orderBy("bin").toPandas()
    counts, edges = np.histogram(numbers["price"], bins=20)
    assert got["n"].tolist() == counts.tolist()
    assert got["low"].tolist() == pytest.approx(edges[:-1].tolist())
    assert got["high"].tolist() == pytest.approx(edges[1:].tolist())


def test_histogram_keeps_empty_bins_and_skips_null(spark):
    df = spark.createDataFrame([(0,), (1,), (100,), (None,)], "x int")
    assert [r.n for r in D.histogram(df, "x", 4).orderBy("bin").collect()] == [2, 0, 0, 1]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3,)] * 5, "x int")
    counts, edges = np.histogram([3] * 5, bins=4)
    rows = D.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == counts.tolist()
    assert [r.low for r in rows] == pytest.approx(edges[:-1].tolist())


def test_box_stats(spark, numbers):
    x = numbers["price"]
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    reach = 1.5 * (q3 - q1)
    inside = x[(x >= q1 - reach) & (x <= q3 + reach)]
    row = D.box_stats(spark.createDataFrame(numbers), "price").first()
    assert (row.q1, row.median, row.q3) == pytest.approx((q1, q2, q3))
    assert (row.whisker_low, row.whisker_high) == (inside.min(), inside.max())
    assert row.outliers == len(x) - len(inside) > 0
    assert row.n == len(x)


def test_box_of_nothing(spark):
    row = D.box_stats(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert tuple(row) == (None, None, None, None, None, 0, 0)


def test_group_means(spark, numbers):
    df = spark.createDataFrame(numbers)
    got = D.group_mean_ci(df, "fuel").toPandas().set_index("fuel").sort_index()
    want = numbers.groupby("fuel")["price"].agg(["count", "mean", "std"])
    assert got["n"].tolist() == want["count"].tolist()
    assert got["mean"].tolist() == pytest.approx(want["mean"].tolist())
    half = 1.96 * want["std"] / np.sqrt(want["count"])
    assert got["ci_low"].tolist() == pytest.approx((want["mean"] - half).tolist())
    assert got["ci_high"].tolist() == pytest.approx((want["mean"] + half).tolist())


def test_interval_of_one_row_is_null(spark):
    df = spark.createDataFrame([("a", 5.0)], "k string, price double")
    assert tuple(D.group_mean_ci(df, "k").first()) == ("a", 1, 5.0, None, None)


def test_group_mean_2d_long_and_wide(spark, numbers):
    df = spark.createDataFrame(numbers)
    want = numbers.groupby(["fuel", "condition"])["price"].mean()
    long = {(r.fuel, r.condition): r["mean"] for r in D.group_mean_2d(df, "fuel", "condition").collect()}
    assert long == pytest.approx(want.to_dict())
    wide = D.group_mean_2d(df, "fuel", "condition", pivot_values=["good", "fair"])
    assert wide.columns == ["fuel", "good", "fair"]
    assert {r.fuel: r.good for r in wide.collect()}["gas"] == pytest.approx(want["gas", "good"])


def test_correlation_matrix(spark, numbers):
    names = ["price", "odometer"]
    got = D.correlation_matrix(spark.createDataFrame(numbers), names).toPandas()
    want = numbers[names].corr()
    assert len(got) == 4
    for row in got.itertuples():
        assert row.r == pytest.approx(want.loc[row.x_col, row.y_col])


def test_sample_is_the_same_for_any_partitioning(spark, numbers):
    df = spark.createDataFrame(numbers).select("odometer", "fuel", "condition")
    one = sorted(tuple(r) for r in D.sample_n(df, 100).collect())
    two = sorted(tuple(r) for r in D.sample_n(df.repartition(9), 100).collect())
    other = sorted(tuple(r) for r in D.sample_n(df, 100, seed=1).collect())
    assert len(one) == 100 and one == two and one != other
    assert D.sample_n(df, 10_000).count() == len(numbers)


def test_pair_plot_data(spark, numbers):
    df = spark.createDataFrame(numbers)
    points = D.pair_plot_data(df, ("price", "odometer"), 50, key=("odometer", "fuel", "condition")).toPandas()
    assert len(points) == 200
    same = points[points.x_col == points.y_col]
    assert (same.x == same.y).all()
    crossed = points[(points.x_col == "price") & (points.y_col == "odometer")]
    known = set(zip(numbers.price, numbers.odometer.astype(float)))
    assert set(zip(crossed.x, crossed.y)) <= known


def test_odd_numbers_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(nan,)] * 5, "x double")
    box = D.box_stats(df, "x").first()
    assert (box.n, box.outliers, box.median) == (10, 0, 5.5)
    assert D.box_stats(df, "x", rel_err=0.01).first().q3 == 8.0
    odd = df.unionAll(spark.createDataFrame([(inf,), (-inf,)], "x double"))
    assert [r.n for r in D.histogram(odd, "x", 2).orderBy("bin").collect()] == [5, 5]
