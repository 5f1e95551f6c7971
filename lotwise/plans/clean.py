"""The cleaning job: from raw listings to the table models are trained on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.columns import car_age, cast_int, drop_columns
from lotwise.operators.clean import group_rare_fixed, keep_listed, quantile_fence
from lotwise.operators.profile import top_k_values
from lotwise.operators.stages import QuantileTrimmerModel, RareGrouper, RareGrouperModel
from lotwise.operators.rows import drop_duplicates, drop_null_rows, fill_unknown
from lotwise.sources.workspace import Owner, materialize, scope


@dataclass(frozen=True)
class Fence:
    """Quantiles of an outlier fence: ``lower`` and ``hi + factor * (hi - lo)``."""

    lower: float
    lo: float
    hi: float
    factor: float = 1.5


@dataclass(frozen=True)
class CleanSpec:
    """Parameters of the cleaning job; the defaults are for vehicle listings."""

    # Dropped, required and kept names of the listings data.
    drop: tuple[str, ...] = (
        "id", "url", "region_url", "VIN", "image_url", "description", "county", "lat", "long",
        "posting_date", "size", "state",
    )
    required: tuple[str, ...] = (
        "region", "price", "year", "model", "odometer", "manufacturer", "transmission",
        "title_status", "fuel",
    )
    makes: tuple[str, ...] = (
        "nissan", "honda", "chevrolet", "mercedes-benz", "ram", "dodge", "ford", "jeep", "toyota",
        "bmw", "subaru", "volkswagen", "kia", "cadillac", "hyundai", "lexus", "audi", "chrysler",
        "acura", "buick",
    )
    transmissions: tuple[str, ...] = ("automatic", "manual", "other", "unknown")
    top_k: Mapping[str, int] = field(default_factory=lambda: {"region": 50, "model": 50})
    price: Fence = Fence(lower=0.15, lo=0.15, hi=0.75)
    odometer: Fence = Fence(lower=0.05, lo=0.25, hi=0.75)
    year_after: int = 1996
    year_excluded: int = 2022
    reference_year: int = 2024
    rel_err: float = 0.01
    keep_year: bool = False


INT_COLUMNS = ("year", "odometer", "price")


@dataclass(frozen=True)
class Learned:
    """What cleaning takes from the data besides the lists of kept values."""

    filters: tuple[tuple[str, Column], ...]
    fences: Mapping[str, tuple[float, float] | None]


def _inside(name: str, fence: tuple[float, float] | None) -> Column:
    if fence is None:
        return F.lit(False)
    return (F.col(name) > F.lit(fence[0])) & (F.col(name) < F.lit(fence[1]))


def learn(base: DataFrame, spec: CleanSpec) -> Learned:
    """Each fence from the deduplicated, cast rows that the steps before it leave."""
    filters = [("transmission in list", F.col("transmission").isin(list(spec.transmissions)))]
    rows, fences = base.where(filters[0][1]), {}
    for name in ("price", "odometer"):
        f: Fence = getattr(spec, name)
        fence = quantile_fence(rows, name, f.lower, f.lo, f.hi, f.factor, spec.rel_err)
        fences[name] = fence
        filters.append((f"{name} in fence", _inside(name, fence)))
        rows = rows.where(filters[-1][1])
    filters += [
        ("year after minimum", F.col("year") > spec.year_after),
        ("year not excluded", F.col("year") != spec.year_excluded),
    ]
    return Learned(tuple(filters), fences)


@dataclass(frozen=True)
class Cleaned:
    """The cleaned rows, and the table that the lists of kept values were learned from.

    Both read one written table, which goes when the result is closed, at the end of
    a ``with`` block or by ``close``, and with the session otherwise.
    """

    rows: DataFrame
    base: DataFrame
    spec: CleanSpec
    fences: Mapping[str, tuple[float, float] | None]
    owner: Owner

    def close(self) -> None:
        self.owner.release()

    def __enter__(self) -> "Cleaned":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def trimmers(self) -> list[QuantileTrimmerModel]:
        """The fences as fitted stages, to trim other rows by what these rows taught; they can be saved.

        A column without values has no fence and no stage. Requests to be scored are grouped but not trimmed.
        """
        return [QuantileTrimmerModel(inputCol=n, fence=list(f)) for n, f in self.fences.items() if f is not None]

    def grouper(self) -> RareGrouperModel:
        """The lists as a fitted stage: it turns raw values into those the rows hold."""
        learned = RareGrouper(inputCols=list(self.spec.top_k), k=list(self.spec.top_k.values())).fit(self.base)
        makes = self.base.sparkSession.createDataFrame([(m,) for m in self.spec.makes], "value string")
        names = [*self.spec.top_k, "manufacturer"]
        return RareGrouperModel(inputCols=names).keeping([*[learned.kept(n) for n in self.spec.top_k], makes])


def clean_listings(df: DataFrame, spec: CleanSpec = CleanSpec()) -> DataFrame:
    """The cleaned rows alone, see ``clean_and_learn``."""
    return clean_and_learn(df, spec).rows


def clean_and_learn(df: DataFrame, spec: CleanSpec = CleanSpec()) -> Cleaned:
    """Drop, deduplicate, null rules, rare values, casts, fences, age.

    The raw table is read once. The deduplicated rows are written as a narrow,
    typed table; lists and fences are learned from single columns of it, and the
    result is one scan of it that the fences are pushed down to, joined with the lists. Casting ahead
    of the rare-value and list rules changes nothing: they read other columns.
    """
    with scope(df.sparkSession) as owner:
        distinct = drop_duplicates(drop_columns(df, *spec.drop))
        filled = fill_unknown(drop_null_rows(distinct, spec.required))
        base = materialize(cast_int(filled, *INT_COLUMNS), "listings")
        learned = learn(base, spec)
        rows = group_rare_fixed(base, "manufacturer", spec.makes)
        for name, k in spec.top_k.items():
            rows = keep_listed(rows, name, top_k_values(base, name, k))
        for _, keep in learned.filters:
            rows = rows.where(keep)
        if spec.keep_year:
            rows = rows.withColumn("_year", F.col("year"))
        aged = car_age(rows, spec.reference_year).withColumnRenamed("_year", "year")
        return Cleaned(aged, base, spec, learned.fences, owner.retain())


def step_counts(df: DataFrame, spec: CleanSpec = CleanSpec()) -> DataFrame:
    """Rows left after each cleaning step, counted in one pass.

    Deduplication keeps the number of copies, so the raw count needs no scan of
    its own, and every later step is a filter over the distinct rows. The counts are
    taken at once, so that the written table can go.
    """
    spark = df.sparkSession
    narrow = drop_columns(df, *spec.drop)
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_copies"))
    present = F.lit(True)
    for name in spec.required:
        present = present & F.col(name).isNotNull()
    filled = fill_unknown(counted.withColumn("_present", present))
    with scope(spark):
        rows = materialize(cast_int(filled, *INT_COLUMNS), "steps")
        learned = learn(rows.where("_present"), spec)
        steps = [
            ("read", F.coalesce(F.sum("_copies"), F.lit(0))),
            ("distinct", F.count(F.lit(1))),
            ("required present", F.count_if("_present")),
        ]
        keep = F.col("_present")
        for name, condition in learned.filters:
            keep = keep & condition
            steps.append((name, F.count_if(keep)))
        measured = rows.agg(*[count.cast("bigint").alias(f"_{i}") for i, (_, count) in enumerate(steps)]).first()
    cells = [(i, name, measured[i]) for i, (name, _) in enumerate(steps)]
    return spark.createDataFrame(cells, "pos int, step string, rows bigint")
