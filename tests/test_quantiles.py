from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lotwise.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.15, 0.25, 0.5, 0.75, 0.999, 1.0]


def lower_quantile(values, p):
    """The smallest value with at least a share ``p`` of the values at or below it."""
    ordered = sorted(values)
    return ordered[max(math.ceil(round(p * len(ordered), 9)), 1) - 1]


def cases():
    rnd = random.Random(5)
    wide = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(500)]
    return {
        "ints": ("int", [rnd.randint(0, 100000) for _ in range(3000)]),
        "one third is one value": ("int", [7] * 1000 + [rnd.randint(0, 10**6) for _ in range(2000)]),
        "single": ("int", [42]),
        "constant": ("int", [5] * 50),
        "two": ("int", [1, 2]),
        "longs at the limits": ("bigint", [-(2**63), 2**63 - 1, 0, 2**53 + 1, 2**53 + 2, 2**62]),
        "doubles": ("double", [rnd.gauss(0, 1e4) for _ in range(3000)]),
        "doubles of every size": ("double", wide),
        "doubles beyond their own range": ("double", [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323]),
        "infinities": ("double", [float("-inf"), float("inf"), 1.0, 2.0, 3.0, float("inf")]),
    }


@pytest.mark.parametrize("name", list(cases()))
def test_exact_against_sorting(spark, name):
    kind, values = cases()[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"x {kind}").repartition(3)
    assert Q.exact_quantiles(df, "x", PROBS) == [float(lower_quantile(values, p)) for p in PROBS]


def test_exact_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,), (2.0,)], "x double")
    assert Q.exact_quantiles(df, "x", [0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0]


def test_interpolated_as_numpy_does(spark):
    rnd = random.Random(9)
    for n in (1, 2, 3, 10, 1001):
        values = [rnd.gauss(50, 20) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = Q.exact_quantiles(df, "x", [0.25, 0.5, 0.75], interpolate=True)
        assert got == pytest.approx(list(np.percentile(values, [25, 50, 75])))


@pytest.mark.parametrize("name", list(cases()))
def test_exact_with_narrow_brackets(spark, monkeypatch, name):
    """The path of large tables, with a coarse sketch and few points, on small ones."""
    monkeypatch.setattr(Q, "GATHER", 8)
    monkeypatch.setattr(Q, "ACCURACY", 50)
    monkeypatch.setattr(Q, "POINTS", 10)
    kind, values = cases()[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"x {kind}").repartition(3)
    assert Q.exact_quantiles(df, "x", PROBS) == [float(lower_quantile(values, p)) for p in PROBS]


def counted(spark, df):
    """The frame, and what says how often it was scanned to its end."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = df.count()
    return df.mapInArrow(passing, df.schema), lambda: seen.value / n


@pytest.mark.parametrize("case", ["every size", "hot value", "longs", "decimals"])
def test_four_scans_at_most_on_any_data(spark, case):
    """Of 300,000 rows, which is beyond what is gathered at once; three columns at a time."""
    noise = "pmod(xxhash64(id, {s}), 1000000007) / 1000000007D"
    made = {
        "every size": f"pow(10D, 600 * {noise} - 300) * (case when id % 2 = 0 then 1 else -1 end)",
        "hot value": f"case when id % 3 = 0 then 5D else 1e9 * {noise} end",
        "longs": "xxhash64(id, {s}) * 1L",
        "decimals": f"cast(1e6 * {noise} as decimal(20,6))",
    }[case]
    df = spark.range(300_000).selectExpr(*[made.format(s=s) + f" as x{s}" for s in range(3)])
    probs = [0.15, 0.5, 0.75, 0.999]
    scanned, scans = counted(spark, df)
    got = Q.exact_quantiles_of(scanned, {f"x{s}": probs for s in range(3)})
    assert scans() <= 4
    frame = df.toPandas()
    for name, values in got.items():
        assert values == [float(lower_quantile(frame[name].tolist(), p)) for p in probs]


def test_sketches_of_all_columns_take_one_scan(spark):
    scanned, scans = counted(spark, spark.range(1000).selectExpr("id a", "id * 2 b", "id * 3 c"))
    Q.quantiles_of(scanned, {"a": [0.5], "b": [0.1, 0.9], "c": [0.5]})
    assert scans() == 1


def test_a_bracket_that_misses_is_mended(spark, monkeypatch):
    """Ends that are nowhere near the rank cost scans, not the result."""
    monkeypatch.setattr(Q, "GATHER", 5)
    real = Q._ends
    monkeypatch.setattr(Q, "_ends", lambda low, high, kind: (low + 40, high + 40) if low < 60 else real(low, high, kind))
    df = spark.range(100).selectExpr("cast(id as int) as x")
    assert Q.exact_quantiles(df, "x", [0.25, 0.5]) == [24.0, 49.0]


def test_sketch_keeps_its_rank_error(spark):
    df = spark.range(100000).selectExpr("cast(id as int) as x")
    for p, v in zip((0.15, 0.75), Q.quantiles(df, "x", [0.15, 0.75], 0.01)):
        assert abs(v / 100000 - p) <= 0.01


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert Q.quantiles(df, "x", [0.5], 0.0) == [None]
    assert Q.quantiles(df, "x", [0.5], 0.01) == [None]


def test_each_column_has_its_own_probabilities(spark):
    df = spark.range(1, 101).selectExpr("id as a", "id * 2 as b")
    rows = [tuple(r) for r in Q.approx_quantiles(df, {"a": [0.25], "b": [0.5, 1.0]}, rel_err=0.0).collect()]
    assert rows == [("a", 0.25, 25.0), ("b", 0.5, 100.0), ("b", 1.0, 200.0)]


def test_table_form(spark):
    df = spark.range(1, 101).selectExpr("id as a", "id * 2 as b")
    rows = [tuple(r) for r in Q.approx_quantiles(df, ["a", "b"], [0.25, 0.5], 0.0).collect()]
    assert rows == [("a", 0.25, 25.0), ("a", 0.5, 50.0), ("b", 0.25, 50.0), ("b", 0.5, 100.0)]
