"""URL filters: host suffixes and path prefixes looked up by short hash.

Each URL becomes the expressions (the last k labels of its host, the first n
characters of its path) for the shapes (k, n) the rules have. Expressions meet
rules on the first four bytes of their SHA-256, full digests confirm, and the
longest rule decides. Everything is a Spark expression or an equi-join; the rule
list may be of any size, since Spark broadcasts it only below its threshold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import ascii_lower, passengers

#: (verdict, host, path) of the standing list.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hex digits of the digest that the join uses: four bytes.
PREFIX = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as rows: rule (host and path), verdict, labels, path_chars, digest, prefix.

    Of equal rules with both verdicts the block stays.
    """
    rows = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rule = F.concat(ascii_lower(F.col("host")), F.col("path"))
    digest = F.sha2(rule, 256)
    return rows.groupBy(
        rule.alias("rule"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_chars"),
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX).alias("prefix"),
    ).agg(F.max("verdict").alias("verdict"))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's expressions for every (labels, path characters) that rules have."""
    found = [
        F.when(F.length(path) >= chars, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))
        for labels, chars in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


@passengers()
def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule (null where none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with its path; the
    longest fitting rule wins (ties: the first by value). A null URL or one
    without ``://`` has an empty host and path, fits nothing and gets
    ``otherwise``. Columns of the input with one of the four names are replaced, others may have any name;
    an empty table or an empty rule list gives the rows without rules. Equal URLs
    are looked up once.
    """
    # One row per shape, as many as rules differ in labels and path length.
    shapes = sorted((r.labels, r.path_chars) for r in rules.select("labels", "path_chars").distinct().collect())
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.drop("rule", "verdict").withColumns({"_host": host, "_path": path})
    places = rows.select("_host", "_path").distinct()
    looked = places.withColumn("_expression", F.explode(expressions(F.col("_host"), F.col("_path"), shapes)))
    looked = looked.withColumn("_digest", F.sha2("_expression", 256))
    hits = looked.join(rules, F.substring("_digest", 1, PREFIX) == F.col("prefix")).where(F.col("_digest") == F.col("digest"))
    best = hits.groupBy("_host", "_path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("_best")
    )
    judged = rows.join(best, ["_host", "_path"], "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(
        *kept,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(otherwise)).alias("verdict"),
    )
