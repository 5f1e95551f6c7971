"""Secret scans over a trigram inverted index, in Spark expressions only.

Every rule's regex gives a Boolean trigram query. The index holds, for each
trigram that some rule asks for, the documents with it; postings are intersected
by counting, per document and set of trigrams, how many are there. Only candidates are verified
with the regex. A rule without a mandatory trigram scans every text. Spans come
from splitting a text at its matches and adding up lengths, so they are in code
points and need no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import passengers
from lotwise.llm.trigrams import ANY, derive


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; then ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: Fixed values. The quantifiers of access and hex hold their least length: a run
#: that is too short has no longer one inside it.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: The key's body and END line, or what is there of the body where the key is cut off; prose after a lone label is no key.
_KEY_HEAD = r"(?:\r?\n[A-Za-z-]+:[^\r\n]*+){0,8}+"
_KEY_BODY = r"[A-Za-z0-9+/=\s\\]*+"
MORE = (
    Rule(
        "private_key",
        rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_HEAD}{_KEY_BODY}-----END [A-Z ]*PRIVATE KEY-----"
        rf"|{_KEY_HEAD}[\s\\]*+[A-Za-z0-9+/=]{{20,}}+{_KEY_BODY})?+",
    ),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

SPAN = "array<struct<start:long,rank:int,stop:long>>"


def _starts(lengths: Column) -> Column:
    """For lengths l0, l1, ... the sums before each, in blocks so that long arrays stay cheap."""
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(lengths) / size).cast("int") - 1),
        lambda b: F.slice(lengths, b * size + 1, size),
    )
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    # A one-element array binds a value to a name, so that it is worked out once.
    return F.flatten(F.transform(F.array(blocks), lambda bs: F.flatten(F.transform(
        F.array(F.transform(bs, add)),
        lambda sums: F.flatten(F.transform(bs, lambda block, b: F.flatten(F.transform(
            F.array(add(F.slice(sums, F.lit(1), b))),
            lambda base: F.transform(block, lambda _, i: base + add(F.slice(block, F.lit(1), i))),
        )))),
    ))))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """(start, rank, stop) of the rule's matches, in code points, stop exclusive."""
    regex = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    kept = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    # Gap and match in turn: match i is preceded by i + 1 gaps and i matches.
    both = F.transform(
        F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), kept.alias("kept")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.coalesce(F.length(x["match"]), F.lit(0)).alias("match"),
            F.coalesce(F.length(x["kept"]), F.lit(-1)).alias("kept"),
        ),
    )
    spans = F.transform(F.array(both), lambda xs: F.transform(
        F.arrays_zip(xs.alias("x"), _starts(F.transform(xs, lambda x: (x["gap"] + x["match"]).cast("long"))).alias("before")),
        lambda z: F.struct(
            (z["before"] + z["x"]["gap"]).alias("start"),
            F.lit(rank).alias("rank"),
            (z["before"] + z["x"]["gap"] + z["x"]["match"]).alias("stop"),
            z["x"]["kept"].alias("kept"),
        ),
    ))[0]
    whole = F.filter(spans, lambda s: s["kept"] >= max(rule.least, 0))
    plain = F.transform(whole, lambda s: F.struct(s["start"], s["rank"], s["stop"]))
    return F.when(text.rlike(rule.pattern), plain).otherwise(F.array()).cast(SPAN)


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key): the documents that hold each trigram some rule asks for."""
    wanted = sorted({g for r in rules for s in derive(r.pattern) for g in s})
    if not wanted:
        return docs.select(F.lit("").alias("gram"), key).where(F.lit(False))
    names = F.array(*map(F.lit, wanted))
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = F.transform(F.array(lowered), lambda low: F.filter(names, lambda g: F.contains(low, g)))[0]
    return docs.select(F.explode(held).alias("gram"), F.col(key))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """One row (key, kinds) for each document that satisfies the query of some rule."""
    spark = postings.sparkSession
    asked = [
        (r.kind, n, len(s), g)
        for r in rules
        if derive(r.pattern) != ANY
        for n, s in enumerate(sorted(map(sorted, derive(r.pattern))))
        for g in s
    ]
    terms = spark.createDataFrame(asked, "kind string, term int, needed int, gram string")
    met = postings.join(F.broadcast(terms), "gram")  # as many rows as the rules have trigrams
    whole = met.groupBy(key, "kind", "term", "needed").agg(F.countDistinct("gram").alias("held"))
    return whole.where(F.col("held") == F.col("needed")).groupBy(key).agg(F.collect_set("kind").alias("_kinds"))


@passengers()
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``secret_spans``: (start, rank of the rule, stop), in order.

    A null text is scanned as empty. Candidates are found by id and verified by
    row, so null and repeated ids are safe: each row gets the spans of its own
    text. Rows and columns stay, of any name, but for an input column ``secret_spans``.
    """
    found = candidates(index(docs, rules, key, text), rules, key).withColumnRenamed(key, "_key")
    rows = docs.drop("secret_spans", "_kinds").join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast(SPAN)
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(whole, rule, rank)
        asked = derive(rule.pattern) != ANY
        parts.append(F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(nothing) if asked else spans)
    return rows.withColumn("secret_spans", F.array_sort(F.flatten(F.array(*parts)))).drop("_key", "_kinds")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["stop"])), ","
    )


@passengers("doc_id")
def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; overlapping spans share one. Other columns may have any name."""
    scanned = scan(docs, rules, text=text)
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, span):
        apart = F.concat(
            acc["out"],
            F.substring(whole, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int")),
            F.lit(mask),
        )
        return F.struct(
            F.greatest(acc["at"], span["stop"]).alias("at"),
            F.when((span["start"] >= acc["at"]), apart).otherwise(acc["out"]).alias("out"),
        )

    masked = F.aggregate(
        "secret_spans", start, step,
        lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))),
    )
    changed = F.when(F.size("secret_spans") > 0, masked).otherwise(F.col(text))
    return scanned.withColumn(text, changed).drop("secret_spans")
