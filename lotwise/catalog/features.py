"""Split and feature vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.catalog.data import KEY, LISTINGS_SQL, listings
from lotwise.catalog.registry import query
from lotwise.functions.columns import car_age
from lotwise.operators import features as X

SPEC = X.FeatureSpec(
    numeric=("odometer", "car_age"),
    label="worth",
)

SPLIT_SQL = f"""{LISTINGS_SQL},
aged as (select *, cast(2024 - "year" as int) car_age,
  substr(md5(concat_ws('|', '23', {', '.join(KEY)})), 1, 8) < 'cccccccd' in_train from listings),
train as (select * from aged where in_train),
test as (select * from aged where not in_train)"""


def aged(spark, sf):
    """Listings before cleaning, nulls in ``condition``, with key, age and label."""
    return car_age(listings(spark, sf, *KEY, *SPEC.categorical, "odometer", "year", "worth"))


def sides(spark, sf):
    """Both sides of the listings, which are joined, split and written once and fitted on several times."""
    return X.written_split(aged(spark, sf), key=KEY)


@query(
    "split_train_test",
    f"with {SPLIT_SQL} select {', '.join(KEY)}, case when in_train then 'train' else 'test' end side from aged",
)
def split_train_test(spark, sf):
    train, test = X.split_train_test(listings(spark, sf, *KEY), key=KEY)
    return train.withColumn("side", F.lit("train")).unionAll(test.withColumn("side", F.lit("test")))


@query(
    "assemble_numeric",
    f"with {SPLIT_SQL} select {', '.join(KEY)}, cast(odometer as double) x0, cast(car_age as double) x1 from aged",
)
def assemble_numeric(spark, sf):
    df = car_age(listings(spark, sf, *KEY, "odometer", "year"))
    values = vector_to_array(X.NUMERIC_VECTOR)
    vectors = X.assemble_numeric(SPEC).transform(df)
    return vectors.select(*KEY, values[0].alias("x0"), values[1].alias("x1"))


@query(
    "standard_scale",
    f"""with {SPLIT_SQL}, s as (select avg(odometer) m0, stddev_samp(odometer) d0, avg(car_age) m1,
          stddev_samp(car_age) d1 from train)
        select {', '.join(KEY)}, round((odometer - m0) / d0, 6) z0, round((car_age - m1) / d1, 6) z1
        from test, s""",
)
def standard_scale(spark, sf):
    df = car_age(listings(spark, sf, *KEY, "odometer", "year"))
    train, test = X.split_train_test(df, key=KEY)
    assembler = X.assemble_numeric(SPEC)
    scaler = X.standard_scale().fit(assembler.transform(train))
    values = vector_to_array(X.SCALED_VECTOR)
    return scaler.transform(assembler.transform(test)).select(
        *KEY, F.round(values[0], 6).alias("z0"), F.round(values[1], 6).alias("z1")
    )


INDEX_SQL = ",\n".join(
    f"""ix_{c} as (select "{c}" v, row_number() over (order by count(*) desc, "{c}") - 1 i
      from train where "{c}" is not null group by "{c}"), n_{c} as (select count(*) n from ix_{c})"""
    for c in SPEC.categorical
)
INDEX_JOIN = " ".join(f'left join ix_{c} on ix_{c}.v = t."{c}"' for c in SPEC.categorical)
SIZES = ", ".join(f"n_{c}" for c in SPEC.categorical)


@query(
    "string_index",
    f"with {SPLIT_SQL}, {INDEX_SQL} select {', '.join('t.' + k for k in KEY)}, "
    + ", ".join(f"cast(coalesce(ix_{c}.i, n_{c}.n) as double) {c}_index" for c in SPEC.categorical)
    + f" from test t {INDEX_JOIN}, {SIZES}",
)
def string_index(spark, sf):
    train, test = sides(spark, sf)
    model = X.string_index(SPEC).fit(train)
    return model.transform(test).select(*KEY, *SPEC.index_columns)


@query(
    "one_hot",
    f"with {SPLIT_SQL}, {INDEX_SQL} select {', '.join('t.' + k for k in KEY)}, "
    + ", ".join(
        f"cast(n_{c}.n as int) {c}_slots, cast(coalesce(ix_{c}.i, -1) as int) {c}_slot" for c in SPEC.categorical
    )
    + f" from test t {INDEX_JOIN}, {SIZES}",
)
def one_hot(spark, sf):
    train, test = sides(spark, sf)
    index = X.string_index(SPEC).fit(train)
    encoder = X.one_hot(SPEC).fit(index.transform(train))
    encoded = encoder.transform(index.transform(test))
    shown = []
    for name, vector in zip(SPEC.categorical, SPEC.one_hot_columns):
        slots = vector_to_array(vector)
        shown += [
            F.size(slots).alias(f"{name}_slots"),
            (F.array_position(slots, 1.0) - 1).cast("int").alias(f"{name}_slot"),
        ]
    return encoded.select(*KEY, *shown)


def _offset(position: int) -> str:
    return " + ".join(["0", *[f"n_{c}.n" for c in SPEC.categorical[:position]]])


ASSEMBLED_SQL = (
    f"""with {SPLIT_SQL}, {INDEX_SQL}, s as (select avg(odometer) m0, stddev_samp(odometer) d0,
      avg(car_age) m1, stddev_samp(car_age) d1 from train)
    select {', '.join('t.' + k for k in KEY)},
      round((odometer - m0) / d0, 6) z0, round((car_age - m1) / d1, 6) z1,
      cast(2 + {' + '.join(f'n_{c}.n' for c in SPEC.categorical)} as int) size,
      cast({' + '.join(f'(ix_{c}.i is not null)::int' for c in SPEC.categorical)} as int) active,
      cast({' + '.join(f'coalesce(ix_{c}.i + {_offset(p)}, 0)' for p, c in enumerate(SPEC.categorical))} as bigint) slot_sum
    from test t {INDEX_JOIN}, s, {SIZES}"""
)


def _assembled(df):
    """Scaled numbers, vector size, and count and sum of the one-hot slots set."""
    values = vector_to_array(X.FEATURES)
    slots = F.slice(values, F.lit(3), F.size(values) - 2)
    places = F.transform(slots, lambda on, i: on * i)
    add = lambda a, b: a + b
    return df.select(
        *KEY,
        F.round(values[0], 6).alias("z0"),
        F.round(values[1], 6).alias("z1"),
        F.size(values).alias("size"),
        F.aggregate(slots, F.lit(0.0), add).cast("int").alias("active"),
        F.aggregate(places, F.lit(0.0), add).cast("bigint").alias("slot_sum"),
    )


@query("assemble_features", ASSEMBLED_SQL)
def assemble_features(spark, sf):
    train, test = sides(spark, sf)
    for stage in X.feature_stages(SPEC):
        fitted = stage.fit(train) if hasattr(stage, "fit") else stage
        train, test = fitted.transform(train), fitted.transform(test)
    return _assembled(test)


@query("feature_pipeline", ASSEMBLED_SQL)
def feature_pipeline(spark, sf):
    train, test = sides(spark, sf)
    fitted: PipelineModel = X.feature_pipeline(train, SPEC)
    return _assembled(fitted.transform(test))
