from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.operators import features as X
from lotwise.operators import models as M
from lotwise.operators.levels import LevelIndexer, LevelIndexerModel, binary_slots
from lotwise.sources.models import load_model, save_model

SPEC = X.FeatureSpec(numeric=("a", "b"), categorical=("c", "d"), label="y")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(
        "id",
        (F.col("id") % 17).cast("int").alias("a"),
        (F.col("id") * 3 % 101).cast("int").alias("b"),
        F.element_at(F.array(*map(F.lit, "xxxyyz")), (F.col("id") % 6 + 1).cast("int")).alias("c"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("d"), F.col("id") % 3)).alias("d"),
        (F.col("id") % 17 * 2.0).alias("y"),
    ).cache()


def test_split_is_a_partition_of_the_rows(spark, rows):
    train, test = X.split_train_test(rows, key=("id",))
    assert train.count() + test.count() == 1000
    assert train.join(test, "id").isEmpty()
    assert 0.76 < train.count() / 1000 < 0.84
    again, _ = X.split_train_test(rows.repartition(7), key=("id",))
    assert again.exceptAll(train).isEmpty()
    other, _ = X.split_train_test(rows, seed=1, key=("id",))
    assert not other.exceptAll(train).isEmpty()


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_split_share(rows, share):
    train, _ = X.split_train_test(rows, share, key=("id",))
    assert abs(train.count() / 1000 - share) < 0.05


def test_random_split_covers_the_rows(rows):
    train, test = X.random_split(rows)
    assert train.count() + test.count() == 1000


def test_pipeline_vectors(spark, rows):
    train, test = X.split_train_test(rows, key=("id",))
    out = X.feature_pipeline(train, SPEC).transform(test)
    frame = out.select("a", "b", "c", "d", vector_to_array(X.FEATURES).alias("v")).toPandas()
    fitted = train.toPandas()
    order = {
        n: fitted[n].dropna().value_counts().reset_index().sort_values(["count", n], ascending=[False, True])[n].tolist()
        for n in ("c", "d")
    }
    for row in frame.itertuples():
        want = [(row.a - fitted.a.mean()) / fitted.a.std(), (row.b - fitted.b.mean()) / fitted.b.std()]
        want += [float(row.c == v) for v in order["c"]] + [float(row.d == v) for v in order["d"]]
        assert np.allclose(row.v, want)


def test_unseen_and_null_are_all_zero(spark, rows):
    model = X.feature_pipeline(rows, SPEC)
    fresh = spark.createDataFrame([(1, 1, "new", None)], "a int, b int, c string, d string")
    assert sum(model.transform(fresh).select(vector_to_array(X.FEATURES)).first()[0][2:]) == 0.0


def test_only_numbers_or_only_categories(rows):
    for spec, size in ((X.FeatureSpec(("a", "b"), (), "y"), 2), (X.FeatureSpec((), ("c",), "y"), 3)):
        vector = X.feature_pipeline(rows, spec).transform(rows).select(X.FEATURES).first()[0]
        assert vector.size == size


def test_index_of_many_levels(spark):
    df = spark.range(150_000).selectExpr("cast(id % 120000 as string) as c")
    table = X.string_index(X.FeatureSpec((), ("c",), "y")).fit(df).levels("c")
    labels = [r.value for r in table.orderBy("level").collect()]
    assert len(labels) == 120_000
    # The 30,000 values that are there twice come first, in order of their text.
    assert labels[:30_000] == sorted(map(str, range(30_000)))


def test_ranks_are_those_of_one_sort(spark):
    """Over many tasks, with ties, a hot value and one column of a single value."""
    df = spark.range(20_000).selectExpr(
        "cast(case when id % 3 = 0 then -1 else id % 5000 end as string) c", "'only' d", "cast(null as string) e", "id % 7 f"
    ).repartition(9)
    names = ["c", "d", "e", "f"]
    model = LevelIndexer(inputCols=names, outputCols=["i0", "i1", "i2", "i3"]).fit(df)
    frame = df.toPandas()
    for name in names:
        counts = Counter(str(v) for v in frame[name].dropna())
        want = sorted(counts, key=lambda v: (-counts[v], v))
        table = model.levels(name)
        got = [] if table is None else [r.value for r in table.orderBy("level").collect()]
        assert got == want
    assert model.getOrDefault(model.sizes) == [len(set(frame[n].dropna())) for n in names]
    indexed = model.transform(df.limit(50))
    assert indexed.columns == [*df.columns, "i0", "i1", "i2", "i3"]
    assert {r.i2 for r in indexed.collect()} == {0.0}


def test_two_million_levels_fit_save_load_and_score(spark, tmp_path):
    """A column of two million levels, one of them a third of the rows, through a saved scorer."""
    levels = 2_000_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10)) + 10)
    df = spark.range(levels).select(
        F.col("id").cast("string").alias("c"), hot.cast("string").alias("d"), (F.col("id") % 100).cast("double").alias("a")
    ).withColumn("y", F.col("a") * 2 + (F.col("d") == "1").cast("int") * 50)
    spec = X.FeatureSpec(numeric=("a",), categorical=("c", "d"), label="y")
    features = X.feature_pipeline(df, spec)
    indexer = next(s for s in features.stages if isinstance(s, LevelIndexerModel))
    sizes = indexer.getOrDefault(indexer.sizes)
    assert sizes == [levels, 11]
    vectors = features.transform(df)
    # The schema stays small: it has no word for a single level.
    assert len(vectors.schema.json()) < 5_000
    shown = vectors.where("c in ('0', '5', '1999999')").select("c", X.FEATURES).collect()
    order = sorted(map(str, [0, 5, levels - 1]))
    assert [int(r[X.FEATURES].indices[1]) for r in sorted(shown)] == sorted(int(r[X.FEATURES].indices[1]) for r in shown)
    assert [r.c for r in sorted(shown)] == order and all(r[X.FEATURES].size == 1 + levels + 11 for r in shown)
    assert all(len(r[X.FEATURES].indices) == 3 for r in shown)
    # One step of the solver: what counts here is that a vector of that length is learned from and saved.
    few = features.transform(df.where("cast(c as long) % 1000 = 0"))
    model = M.fit(M.linear("y").copy({M.linear("y").maxIter: 1}), few)
    path = save_model(PipelineModel([*features.stages, model]), str(tmp_path / "model"))
    loaded = load_model(path)
    requests = spark.createDataFrame([("5", "1", 3.0), ("never", None, 3.0), (None, "99", 4.0)], "c string, d string, a double")
    before = PipelineModel([*features.stages, model]).transform(requests).select("c", "prediction").collect()
    after = loaded.transform(requests).select("c", "prediction").collect()
    assert sorted(map(str, before)) == sorted(map(str, after)) and len(after) == 3


def test_one_hot_vectors(spark, rows):
    index = X.string_index(SPEC).fit(rows)
    indexed = index.transform(rows)
    out = X.one_hot(SPEC).fit(indexed).transform(indexed)
    for row in out.select("d", "d_index", "d_vector").distinct().collect():
        want = [0.0] * 3
        if row.d is not None:
            want[int(row.d_index)] = 1.0
        assert row.d_vector.toArray().tolist() == want and row.d_vector.size == 3


def test_features_of_an_empty_table(spark, rows):
    fitted = X.string_index(SPEC).fit(rows.limit(0))
    assert fitted.getOrDefault(fitted.sizes) == [0, 0]
    out = fitted.transform(rows)
    assert {(r.c_index, r.d_index) for r in out.select("c_index", "d_index").collect()} == {(0.0, 0.0)}


def test_trees_see_slots_as_categories(rows):
    """A level too rare for a sample of thresholds can be split on."""
    vectors = X.feature_pipeline(rows, SPEC).transform(rows)
    marked = binary_slots(vectors, X.FEATURES)
    attributes = marked.schema[X.FEATURES].metadata["ml_attr"]
    assert attributes["num_attrs"] == 8 and [a["idx"] for a in attributes["attrs"]["binary"]] == [2, 3, 4, 5, 6, 7]
    assert binary_slots(rows, "a").schema == rows.schema
