from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lotwise.plans.clean import CleanSpec, clean_listings
from lotwise.sources import frames, workspace
from lotwise.sources.csv import read_csv, write_csv


def test_free_text_round_trip(spark, tmp_path):
    texts = ['plain', 'a "quoted" word', "a, comma", "two\nlines", "  blanks  ", 'end"', "", None, "back\\slash"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = str(tmp_path / "texts")
    write_csv(df, path)
    back = read_csv(spark, path, df.schema, multi_line=True, empty_as_null=False)
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))
    usual = read_csv(spark, path, df.schema, multi_line=True)
    assert {r.id: r.text for r in usual.collect()} == {i: t or None for i, t in enumerate(texts)}


def test_inferred_types_and_headers(spark, tmp_path):
    path = str(tmp_path / "n")
    write_csv(spark.range(1000).selectExpr("id", "id / 4 as x", "concat('v', id) as s").repartition(4), path)
    back = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in back.schema] == ["int", "double", "string"]
    assert back.count() == 1000


def test_small_files_by_record_count(spark, tmp_path):
    path = tmp_path / "parts"
    write_csv(spark.range(0, 100, 1, 1), str(path), max_records_per_file=30)
    assert len(list(path.glob("part-*.csv"))) == 4


def test_vehicles_through_csv(spark, vehicles, tmp_path):
    path = str(tmp_path / "vehicles")
    write_csv(vehicles, path)
    spec = CleanSpec(rel_err=0.0)
    direct = clean_listings(vehicles.replace("", None), spec)
    typed = clean_listings(read_csv(spark, path, vehicles.schema).replace("", None), spec)
    assert direct.exceptAll(typed).isEmpty() and typed.exceptAll(direct).isEmpty()


def test_malformed_record_modes(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\nx,3\n")
    kept = read_csv(spark, str(path), "a int, b int").collect()
    assert [tuple(r) for r in kept] == [(1, 2), (None, 3)]
    dropped = read_csv(spark, str(path), "a int, b int", mode="DROPMALFORMED").collect()
    assert [tuple(r) for r in dropped] == [(1, 2)]


def test_schema_table(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "n int, s string")
    assert [tuple(r) for r in frames.schema_table(df).collect()] == [(0, "n", "int", True), (1, "s", "string", True)]
    assert [tuple(r)[4:] for r in frames.schema_table(df, with_nulls=True).collect()] == [(2, 0), (2, 1)]


def test_preview_and_rows(spark):
    df = frames.rows_to_df(spark, [("b", 1.0, 2.0, 3.0, 4.0), ("a", None, 2.0, 3.0, 4.0)], frames.METRIC_SCHEMA)
    assert df.schema == frames.METRIC_SCHEMA
    assert [r.Model for r in frames.preview(df, 1, order_by=("Model",)).collect()] == ["a"]


def test_written_stage_prunes_columns_and_keeps_rows(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("text"))
    for rebalance in (False, True):
        stage = workspace.materialize(df, "t", rebalance=rebalance)
        assert stage.dtypes == df.dtypes and stage.count() == 1000
        plan = stage.select("id")._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<id:bigint>" in plan


def test_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = workspace.shared_folder(spark)
    assert configured is None or folder == configured.rstrip("/")


def test_held_frames_are_let_go(spark):
    df = spark.range(10)
    with pytest.raises(RuntimeError), workspace.held(df) as (frame,):
        assert frame.is_cached
        raise RuntimeError
    assert not df.is_cached
