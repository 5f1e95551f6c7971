"""Lists of any length, intervals by resampling, and text files with broken lines."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators import clean, describe
from lotwise.operators import profile as P
from lotwise.operators.ranks import most_frequent
from lotwise.operators.stages import RareGrouper, RareGrouperModel
from lotwise.sources.csv import read_csv, read_csv_checked, write_csv


def ranked(values, k):
    """The k most frequent values; equal counts by value, null first."""
    counts = Counter(values)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0] is not None, c[0] or ""))[:k]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 40, 41, 200, 10_000])
def test_threshold_list_equals_the_sorted_one(spark, k):
    """With a hot value, null in the list, a tie across the cut and lists longer than there are values."""
    values = ["hot"] * 500 + [None] * 3 + [f"v{i % 90}" for i in range(270)] + [f"once{i}" for i in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {(r.v, r["count"]) for r in most_frequent(P.value_counts(df, "v"), "v", k).collect()}
    assert got == set(ranked(values, k))


def test_a_million_values_are_kept(spark, tmp_path):
    """A list of a million values, cut inside a tie, in a saved and loaded stage."""
    k = 1_000_000
    df = spark.range(1_400_000).select(
        F.when(F.col("id") % 7 == 0, F.lit("hot")).otherwise(F.format_string("%07d", F.col("id"))).alias("v")
    )
    listed = P.top_k_values(df, "v", k)
    assert listed.count() == k
    last = listed.where("count = 1").agg(F.max("v"), F.min("v")).first()
    ids = [i for i in range(1_400_000) if i % 7][: k - 1]
    assert tuple(last) == (f"{ids[-1]:07d}", f"{ids[0]:07d}")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    model = RareGrouper(inputCols=["v"], k=[k]).fit(df)
    path = str(tmp_path / "grouper")
    model.write().save(path)
    loaded = RareGrouperModel.load(path)
    fresh = spark.createDataFrame([("hot",), ("0000001",), (f"{ids[-1]:07d}",), (f"{ids[-1] + 1:07d}",), ("new",), (None,)], "v string")
    want = sorted(["hot", "0000001", f"{ids[-1]:07d}", "others", "others", "others"])
    assert sorted(r.v for r in loaded.transform(fresh).collect()) == want
    grouped = clean.group_rare_topk(df, "v", k).groupBy("v").count().where("v = 'others'").first()
    assert grouped["count"] == 1_400_000 - 200_000 - (k - 1)


def plain_bootstrap(rows, draws, seed, level):
    """rows of (group, value, key texts); what the interval must be, draw by draw."""
    bounds = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    means = defaultdict(list)
    for draw in range(draws):
        total, weight = defaultdict(float), defaultdict(int)
        for group, value, *key in rows:
            text = "|".join([str(seed), str(draw // 8), *map(str, key)])
            u = int(hashlib.md5(text.encode()).hexdigest()[draw % 8 * 4 : draw % 8 * 4 + 4], 16)
            times = sum(u >= math.floor(65536 * b + 0.5) for b in bounds if math.floor(65536 * b + 0.5) < 65536)
            total[group] += times * value
            weight[group] += times
        for group in weight:
            if weight[group]:
                means[group].append(total[group] / weight[group])
    tail = 50 * (1 - level)
    return {g: (np.percentile(m, tail), np.percentile(m, 100 - tail)) for g, m in means.items()}


def test_bootstrap_equals_drawing_one_by_one(spark):
    rows = [("abc"[i % 3] if i % 10 else None, float(i * i % 97), i) for i in range(120)] + [("one", 5.0, 500)]
    df = spark.createDataFrame([*rows, ("a", None, 900)], "g string, price double, id long")
    want = plain_bootstrap(rows, 24, 7, 0.9)
    for parts in (1, 6):
        got = describe.group_mean_bootstrap(df.repartition(parts), "g", ["id"], draws=24, seed=7, level=0.9)
        found = {r.g: r for r in got.collect()}
        assert set(found) == set(want)
        for g, r in found.items():
            assert (r.ci_low, r.ci_high) == pytest.approx(want[g])
            assert r.mean == pytest.approx(np.mean([v for k, v, _ in rows if k == g]))
    other = describe.group_mean_bootstrap(df, "g", ["id"], draws=24, seed=8, level=0.9).where("g = 'a'").first()
    assert other.ci_low != found["a"].ci_low


def test_bootstrap_is_near_the_normal_interval_and_copies_no_row(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("price"))
    drawn = describe.group_mean_bootstrap(df, "g", ["id"])
    normal = {r.g: r for r in describe.group_mean_ci(df, "g").collect()}
    for r in drawn.collect():
        width = normal[r.g].ci_high - normal[r.g].ci_low
        assert abs(r.ci_low - normal[r.g].ci_low) < 0.35 * width and abs(r.ci_high - normal[r.g].ci_high) < 0.35 * width
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Expand" not in plan
    assert sum(describe.POISSON[k] for k in (0, 1)) == round(65536 * math.exp(-1)) + round(65536 * 2 * math.exp(-1))


def test_bootstrap_adds_up_whole_batches(spark):
    """No weight is a column of the rows, so the generated code stays small; whole numbers and any kind of group count."""
    df = spark.range(5_000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 101).cast("int").alias("price"))
    drawn = describe.group_mean_bootstrap(df, "g", ["id"])
    assert "CASE WHEN" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    want = plain_bootstrap([(i % 3, i % 101, i) for i in range(5_000)], 96, 23, 0.95)
    by_struct = describe.group_mean_bootstrap(df.withColumn("g", F.struct("g")), "g", ["id"]).select("g.g", "ci_low", "ci_high")
    for r in [*drawn.collect(), *by_struct.collect()]:
        assert (r.ci_low, r.ci_high) == pytest.approx(want[r.g], rel=1e-12)


ROWS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])


def test_no_line_is_lost(spark, tmp_path):
    """Good and corrupt lines add up, over several files with headers."""
    good = ["1,one,2020-01-01", '2,"two, with a comma",2020-01-02', '3,"with ""quotes""",2020-01-03', "4,,", '5,"",2020-02-29', ",,"]
    corrupt = ['6,"open quote,2020-01-01', "x,text for a number,2020-01-01", "7,few", "8,one,2020-01-01,more", "9,bad day,2020-13-45", '"10,a,2020-01-01']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join(["id,name,day", *good[:3], *corrupt[:3], ""]))
    (tmp_path / "in/b.csv").write_text("\n".join(["id,name,day", *corrupt[3:], "", *good[3:]]) + "\n")
    rows, bad = read_csv_checked(spark, str(tmp_path / "in"), ROWS)
    found = bad.collect()
    assert sorted(r["_corrupt"] for r in found) == sorted(corrupt)
    assert {r["_file"].rpartition("/")[2]: r["_line"] for r in sorted(found)} and {r["_file"].rpartition("/")[2] for r in found} == {"a.csv", "b.csv"}
    places = {r["_corrupt"]: (r["_file"].rpartition("/")[2], r["_block"], r["_line"]) for r in found}
    assert len(set(places.values())) == len(corrupt)
    kept = {(r.id, r.name) for r in rows.collect()}
    assert rows.count() == len(good)
    assert {(1, "one"), (2, "two, with a comma"), (3, 'with "quotes"'), (4, None)} <= kept
    with pytest.raises(ValueError):
        read_csv_checked(spark, str(tmp_path / "in"), T.StructType([T.StructField("_corrupt", T.StringType())]))


def test_export_to_a_number_of_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('a,', id) t").repartition(7)
    for files in (1, 3):
        path = str(tmp_path / f"out{files}")
        write_csv(df, path, files=files)
        assert len(list((tmp_path / f"out{files}").glob("part-*.csv"))) == files
        assert read_csv(spark, path, "id long, t string").exceptAll(df).isEmpty()
