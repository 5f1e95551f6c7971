"""Scoring whole tables with one saved pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.columns import int_price_text
from lotwise.operators import moments
from lotwise.operators.features import FeatureSpec, feature_stages
from lotwise.operators.models import fit
from lotwise.operators.stages import RareGrouper
from lotwise.sources.workspace import materialize, scope

# What each field of a score request may hold.
DOMAINS = {
    "condition": ("salvage", "new", "used", "like new", "good", "fair", "excellent", "unknown"),
    "fuel": ("gas", "diesel", "hybrid", "electric", "other"),
    "title_status": ("lien", "missing", "clean", "rebuilt", "salvage", "parts only"),
    "transmission": ("automatic", "manual", "other"),
    "drive": ("fwd", "rwd", "4wd", "unknown"),
    "type": (
        "sedan", "van", "mini-van", "offroad", "wagon", "coupe", "bus", "SUV", "pickup",
        "truck", "hatchback", "convertible", "Other",
    ),
    "paint_color": (
        "white", "orange", "grey", "green", "yellow", "silver", "purple", "red", "black",
        "brown", "blue", "custom", "unknown",
    ),
}


def fit_scorer(
    train: DataFrame, spec: FeatureSpec, estimator, top_k: Mapping[str, int] | None = None
) -> PipelineModel:
    """Rare-value lists, features and model fitted as one pipeline.

    ``top_k`` names columns whose rare values the pipeline itself groups, so a
    raw value in a request is grouped as it was in training.
    """
    top_k = dict(top_k or {})
    grouping = [RareGrouper(inputCols=list(top_k), k=list(top_k.values()))] if top_k else []
    features = Pipeline(stages=[*grouping, *feature_stages(spec)]).fit(train)
    vectors = features.transform(train).select(estimator.getFeaturesCol(), estimator.getLabelCol())
    if moments.supports(estimator):
        return PipelineModel([*features.stages, fit(estimator, vectors)])
    with scope(train.sparkSession):  # trees go over the vectors several times
        return PipelineModel([*features.stages, fit(estimator, materialize(vectors, "train"))])


def score_listings(model: PipelineModel, requests: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add ``prediction`` to any number of requests, read by column name.

    Missing categories count as ``unknown``. A request without one of its
    numbers keeps its row and gets a null prediction.
    """
    names = [*spec.numeric, *spec.categorical]
    absent = [n for n in names if n not in requests.columns]
    if absent:
        raise ValueError(f"requests lack {absent}")
    passed = [f"_given_{i}" for i in range(len(requests.columns))]
    # Requests come back as given, also where the pipeline regroups a column.
    kept = requests.select("*", *[F.col(c).alias(p) for c, p in zip(requests.columns, passed)])
    scored = model.transform(kept.na.fill("unknown", subset=list(spec.categorical)))
    complete = reduce(Column.__and__, [F.col(n).isNotNull() for n in spec.numeric], F.lit(True))
    return scored.select(
        *[F.col(p).alias(c) for c, p in zip(requests.columns, passed)],
        F.when(complete, F.col("prediction")).alias("prediction"),
    )


def score_text(scored: DataFrame, prefix: str = "Your Car Price is $") -> DataFrame:
    """Replace the prediction by its text."""
    text = int_price_text(F.col("prediction"), prefix).alias("price_text")
    return scored.select(*[c for c in scored.columns if c != "prediction"], text)


def _violates(name: str, allowed: Sequence) -> Column:
    return F.coalesce(~F.col(name).isin(list(allowed)), F.lit(True))


def flag_domains(df: DataFrame, domains: Mapping[str, Sequence] = DOMAINS) -> DataFrame:
    """Add the names of the columns whose value is not allowed; null is not."""
    flags = [F.when(_violates(n, v), F.lit(n)) for n, v in domains.items()]
    return df.withColumn("violations", F.array_compact(F.array(*flags)))


def validate_domains(df: DataFrame, domains: Mapping[str, Sequence] = DOMAINS) -> DataFrame:
    """Rows and violations per column, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_violates(n, v)).alias(f"_bad_{i}") for i, (n, v) in enumerate(domains.items())],
    )
    rows = [
        F.struct(
            F.lit(n).alias("column_name"), F.col("_rows").alias("rows"), F.col(f"_bad_{i}").alias("violations")
        )
        for i, n in enumerate(domains)
    ]
    return counted.select(F.inline(F.array(*rows)))
