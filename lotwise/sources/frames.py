"""Small literal frames and views of a frame's head and schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("Model", T.StringType(), True),
        T.StructField("R2", T.DoubleType(), True),
        T.StructField("Mse", T.DoubleType(), True),
        T.StructField("Mae", T.DoubleType(), True),
        T.StructField("Rmse", T.DoubleType(), True),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType(), True) for name in ("car_age", "odometer")]
    + [
        T.StructField(name, T.StringType(), True)
        for name in (
            "manufacturer", "model", "condition", "cylinders", "fuel", "title_status",
            "transmission", "drive", "type", "paint_color", "region",
        )
    ]
)


def rows_to_df(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """Literal rows with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def request_to_df(spark: SparkSession, **values) -> DataFrame:
    """One score request, by name, as a one-row frame; every field is required."""
    expected = set(REQUEST_SCHEMA.names)
    if set(values) != expected:
        raise ValueError(f"request fields must be {sorted(expected)}, got {sorted(values)}")
    row = tuple(
        float(values[f.name])
        if isinstance(f.dataType, T.DoubleType) and values[f.name] is not None
        else values[f.name]
        for f in REQUEST_SCHEMA
    )
    return spark.createDataFrame([row], REQUEST_SCHEMA)


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; which rows is only defined with ``order_by``."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def schema_table(df: DataFrame, with_nulls: bool = False) -> DataFrame:
    """Position, name, type and nullability of each column.

    ``with_nulls`` adds the rows and nulls seen, from one pass over the table.
    """
    names = [f.name for f in df.schema]

    def entry(pos: int, field: T.StructField):
        parts = [
            F.lit(pos).alias("pos"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.nullable).alias("nullable"),
        ]
        if with_nulls:
            parts += [F.col("_rows").alias("rows"), F.col(f"_nulls_{pos}").alias("nulls")]
        return F.struct(*parts)

    if with_nulls:
        seen = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"_nulls_{i}") for i, n in enumerate(names)],
        )
    else:
        seen = df.sparkSession.range(1)
    return seen.select(F.inline(F.array(*[entry(i, f) for i, f in enumerate(df.schema)])))
