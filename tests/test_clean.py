from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lotwise.operators import clean as C
from lotwise.operators.quantiles import quantiles
from lotwise.operators import profile
from lotwise.operators.profile import null_counts
from lotwise.plans import clean as job
from lotwise.plans.clean import CleanSpec, clean_listings, step_counts
from lotwise.sources.models import load_model, save_model

EXACT = CleanSpec(rel_err=0.0)


def whole(text):
    try:
        value = float(text)
    except (TypeError, ValueError):
        return np.nan
    return float(int(value)) if abs(value) < 2**31 else np.nan


def at_rank(values, p):
    ordered = sorted(v for v in values if not np.isnan(v))
    return ordered[max(int(np.ceil(round(p * len(ordered), 9))), 1) - 1]


def by_hand(raw: pd.DataFrame, spec: CleanSpec):
    """The cleaning rules in pandas, and the rows left after each."""
    left = [len(raw)]
    df = raw.drop(columns=list(spec.drop)).drop_duplicates()
    left.append(len(df))
    df = df.dropna(subset=list(spec.required))
    left.append(len(df))
    df = df.fillna("unknown")
    df["manufacturer"] = df["manufacturer"].where(df["manufacturer"].isin(spec.makes), "others")
    for name, k in spec.top_k.items():
        counts = df.groupby(name).size().reset_index(name="n")
        top = counts.sort_values(["n", name], ascending=[False, True])[name].head(k)
        df[name] = df[name].where(df[name].isin(top), "others")
    df = df[df["transmission"].isin(spec.transmissions)].copy()
    left.append(len(df))
    for name in ("year", "odometer", "price"):
        df[name] = df[name].map(whole)
    for name in ("price", "odometer"):
        fence = getattr(spec, name)
        low, lo, hi = (at_rank(df[name], p) for p in (fence.lower, fence.lo, fence.hi))
        df = df[(df[name] > low) & (df[name] < hi + fence.factor * (hi - lo))]
        left.append(len(df))
    df = df[df["year"] > spec.year_after]
    left.append(len(df))
    df = df[df["year"] != spec.year_excluded].copy()
    left.append(len(df))
    df["car_age"] = spec.reference_year - df["year"]
    return df.drop(columns="year"), left


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in ("price", "odometer", "car_age"):
        df[name] = df[name].astype("int64")
    return df.astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)


def test_clean_listings_by_hand(spark, vehicles):
    expected, left = by_hand(vehicles.toPandas(), EXACT)
    cleaned = clean_listings(vehicles, EXACT)
    pd.testing.assert_frame_equal(ordered(cleaned.toPandas()), ordered(expected))
    counted = [r["rows"] for r in step_counts(vehicles, EXACT).orderBy("pos").collect()]
    assert counted == left
    assert all(a > b for a, b in zip(left, left[1:])), "the fixture should exercise every step"


def test_cleaned_schema_and_bounds(spark, vehicles):
    cleaned = clean_listings(vehicles, EXACT)
    kinds = {f.name: f.dataType.simpleString() for f in cleaned.schema}
    assert len(kinds) == 14
    assert {n for n, t in kinds.items() if t == "int"} == {"price", "odometer", "car_age"}
    assert set(null_counts(cleaned).first()) == {0}
    unique = {n: cleaned.select(n).distinct().count() for n in ("manufacturer", "region", "model", "transmission")}
    assert unique["manufacturer"] <= 21 and unique["region"] <= 51 and unique["model"] <= 51
    assert unique["transmission"] <= 4


def test_clean_does_not_depend_on_partitions(spark, vehicles):
    once = clean_listings(vehicles, EXACT)
    again = clean_listings(vehicles.repartition(11), EXACT)
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_sketched_fences_stay_near_the_exact_ones(spark, vehicles):
    exact, sketched = clean_listings(vehicles, EXACT).count(), clean_listings(vehicles).count()
    assert abs(exact - sketched) <= 0.05 * exact


def test_clean_an_empty_table(spark, vehicles):
    empty = vehicles.limit(0)
    assert clean_listings(empty, EXACT).count() == 0
    assert {r["rows"] for r in step_counts(empty, EXACT).collect()} == {0}


def test_half_the_rows_one_value(spark, vehicles):
    hot = vehicles.withColumn("model", F.when(F.col("id").endswith("1"), F.col("model")).otherwise("hot"))
    spec = replace(EXACT, top_k={"region": 50, "model": 3})
    expected, _ = by_hand(hot.toPandas(), spec)
    pd.testing.assert_frame_equal(ordered(clean_listings(hot, spec).toPandas()), ordered(expected))


def test_group_rare_topk(spark):
    df = spark.createDataFrame([(v, i) for i, v in enumerate("aaabbccd")] + [(None, 9)], "v string, i int")
    grouped = {(r.i, r.v) for r in C.group_rare_topk(df, "v", 2).collect()}
    assert grouped == {(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "others"), (6, "others"),
                       (7, "others"), (9, "others")}
    assert C.group_rare_topk(df, "v", 2).columns == ["v", "i"]


def test_null_takes_a_place_among_the_frequent(spark):
    df = spark.createDataFrame([(None,)] * 3 + [("a",)] * 2 + [("b",)], "v string")
    assert sorted(r.v for r in C.group_rare_topk(df, "v", 2).collect()) == ["a", "a"] + ["others"] * 4


def test_long_lists_take_the_same_path(spark):
    df = spark.range(15000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as v", "id")
    grouped = C.group_rare_topk(df, "v", 10001)
    assert grouped.count() == 15000 and grouped.where("v = 'others'").isEmpty()
    assert "broadcast" not in grouped._jdf.queryExecution().analyzed().toString()
    assert len(profile.top_values(df, {"v": 10001})["v"]) == 10001


def test_year_may_stay(spark, vehicles):
    dated = clean_listings(vehicles, replace(EXACT, keep_year=True))
    plain = clean_listings(vehicles, EXACT)
    assert dated.drop("year").exceptAll(plain).isEmpty() and dated.where("car_age <> 2024 - year").isEmpty()
    assert dated.count() == plain.count() > 0


@pytest.mark.parametrize("share", [1, 10, 33])
def test_nan_is_no_value(spark, share):
    nan = float("nan")
    df = spark.createDataFrame([(float(i) if i % 100 >= share else nan,) for i in range(1000)], "x double")
    whole = spark.createDataFrame([(float(i),) for i in range(1000) if i % 100 >= share], "x double")
    exact = quantiles(df, "x", [0.15, 0.75], 0.0)
    assert exact == quantiles(whole, "x", [0.15, 0.75], 0.0)
    # A hundredth of the rows, here of the span of the values.
    assert np.allclose(quantiles(df, "x", [0.15, 0.75], 0.01), exact, atol=10 * 1.5)
    kept = C.trim_by_quantile(df, "x", 0.05, 0.25, 0.75, rel_err=0.0)
    assert kept.exceptAll(C.trim_by_quantile(whole, "x", 0.05, 0.25, 0.75, rel_err=0.0)).isEmpty() and kept.count() > 0


def test_trims(spark):
    df = spark.range(1, 101).selectExpr("cast(id as int) as price", "cast(id as int) as odometer")
    outliers = df.unionAll(spark.createDataFrame([(10000, 50), (50, 10000)], df.schema))
    prices = C.trim_price(outliers, rel_err=0.0)
    assert prices.agg(F.min("price"), F.max("price")).first() == (17, 100)
    assert C.trim_odometer(df, rel_err=0.0).agg(F.min("odometer")).first()[0] == 6
    assert C.trim_price(df.limit(0), rel_err=0.0).count() == 0


def test_year_rules(spark):
    df = spark.createDataFrame([(y,) for y in (1995, 1996, 1997, 2021, 2022, 2023, None)], "year int")
    assert sorted(r.car_age for r in C.year_rules(df).collect()) == [1, 3, 27]


@pytest.mark.parametrize("keep", [["a"], []])
def test_group_rare_fixed(spark, keep):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert [r.v for r in C.group_rare_fixed(df, "v", keep).collect()] == [keep[0] if keep else "others", "others", "others"]


def test_fences_are_stages_that_trim_other_rows(spark, vehicles, tmp_path):
    """Saved and loaded, they keep what the cleaning keeps of its own rows, and judge new ones alike."""
    spec = job.CleanSpec()
    with job.clean_and_learn(vehicles, spec) as cleaned:
        path = save_model(PipelineModel(cleaned.trimmers()), str(tmp_path / "fences"))
        allowed = cleaned.base.where(F.col("transmission").isin(list(spec.transmissions)))
        years = (F.col("year") > spec.year_after) & (F.col("year") != spec.year_excluded)
        assert load_model(path).transform(allowed).where(years).count() == cleaned.rows.count() > 0
        low, high = cleaned.fences["price"]
        fresh = spark.createDataFrame([(low, 50_000.0), (high, 50_000.0), ((low + high) / 2, 50_000.0)], "price double, odometer double")
        assert [r.price for r in load_model(path).transform(fresh).collect()] == [(low + high) / 2]
