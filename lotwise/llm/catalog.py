"""The text operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.catalog.registry import Build
from lotwise.llm import backoff, bpe, chunks, html, minhash, quality, secrets, sharding, spelling, suffix_dedup, templates, url_filter, whitening
from lotwise.llm.common import table

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op2_secret_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secrets.BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{rule.kind}") for rank, rule in enumerate(secrets.BASE)]
    return secrets.scan(docs).select(
        "doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans")
    )


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.matches(docs, table(spark, sf_dir, "benchmark")).drop("row")


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=2).drop("row")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.strip(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_byte_level_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, digests=True)


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)


@query(
    "op10_url_filters",
    f"""with rules(verdict, h, p) as (values {_RULES}),
parts as (select page_id, {_HOST} host, {_PATH} path, row_number() over () n from pages),
best as (select n, arg_max(h || p, length(h || p)) rule, arg_max(r.verdict, length(h || p)) verdict
  from parts join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from parts left join best using (n)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark)).drop("url")


@query("op11_lm_scoring")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
