"""Columns of any name come through every operator that keeps columns, and through the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import chunks, html, minhash, quality, secrets, templates, url_filter

#: Names that operators use inside, or did, and names that need quotes.
CLASHES = [
    "host", "template", "_large", "_html", "_own", "_host", "_path", "_template", "_id", "_gone", "_row", "_key", "_kinds",
    "secret_spans", "_removed", "_best", "_digest", "digest", "prefix", "row", "kept", "removed", "total", "page", "a b", "c.d", "passenger_0", "passenger_3",
    "block", "n_words", "_n_words", "n_tokens", "rule", "verdict", "path", "doc", "band", "word", "item_id",
]
rng = np.random.default_rng(5)
WORDS = ["".join(rng.choice(list("abdeilmnorstu"), 6)) for _ in range(400)]
PROSE = [" ".join(rng.choice(WORDS, 80)) for _ in range(6)]
TEXTS = [*PROSE, PROSE[0], PROSE[0] + " end", None, "", "password = abcdefghijklmnop0 " + PROSE[1], PROSE[2] + "\n" + PROSE[3]]
BENCH = [(1, " ".join(PROSE[5].split()[:40])), (None, None)]


def clashing(df, names):
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.monotonically_increasing_id().cast("string")).alias(n) for n in names if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, PROSE[4], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def pages(spark):
    article = "<html><body><nav>Menu</nav><article><p>Text {0} of the page.</p></article></body></html>"
    rows = [(i, f"https://a{i % 2}.example.org/es/{i}", article.format(i)) for i in range(12)] + [(12, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)


def same(wide, plain, results=()):
    """Names and rows of the plain result, and the clashing columns as they were."""
    taken = [n for n in CLASHES if n not in plain.columns]
    assert set(wide.columns) == {*plain.columns, *taken}
    quoted = [f"`{c}`" for c in plain.columns]
    assert sorted(map(str, wide.select(*quoted).collect())) == sorted(map(str, plain.select(*quoted).collect()))
    for r in wide.select(*[f"`{n}`" for n in taken]).collect():
        places = {str(r[n]).rpartition(":")[2] for n in taken}
        assert len(places) == 1 and all(str(r[n]).startswith(f"{n}:") for n in taken)


@pytest.mark.parametrize("operator", [secrets.scan, secrets.redact, chunks.strip])
def test_rows_stay(docs, operator):
    same(operator(clashing(docs, CLASHES)), operator(docs))


def test_near_dedup(docs):
    distinct = docs.dropDuplicates()
    same(minhash.dedup(clashing(distinct.coalesce(1), CLASHES)), minhash.dedup(distinct))


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got, plain = templates.clean(clashing(docs, CLASHES), bench), templates.clean(docs, bench)
    assert plain.count() < docs.count()
    same(got, plain)


def test_pages(spark, pages):
    same(html.extract(clashing(pages, CLASHES)), html.extract(pages))
    rules = url_filter.rule_table(spark)
    same(url_filter.judge(clashing(pages, CLASHES), rules), url_filter.judge(pages, rules))


def test_result_wins_over_a_column_of_its_name(pages):
    got = html.extract(pages.withColumn("n_chars", F.lit("mine")).withColumn("text", F.lit("mine")))
    assert got.columns.count("text") == 1 and got.columns.count("n_chars") == 1
    assert "mine" not in {r.text for r in got.collect()}


@pytest.mark.parametrize("stage", range(4))
def test_stages_return_the_columns_they_got(spark, docs, tmp_path, stage):
    folder = str(tmp_path / "tables")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    name, function = corpus_pipeline.STAGES[stage]
    wide = clashing(docs, CLASHES)
    got = function(spark, wide, folder)
    assert set(got.columns) == set(wide.columns), name
    plain = function(spark, docs, folder)
    assert got.count() == plain.count()
    assert function(spark, wide.limit(0), folder).count() == 0
