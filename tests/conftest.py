from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))

from lotwise.session import get_session  # noqa: E402
from lotwise.sources.workspace import clear  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()


def pick(seed: int, *values):
    """One of the values for each row, by hash; None is a value like any other."""
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(len(values)))
    chosen = F.lit(None).cast("string")
    for i, value in enumerate(values):
        chosen = F.when(place == i, F.lit(value)).otherwise(chosen)
    return chosen


@pytest.fixture(scope="session")
def vehicles(spark):
    """2,400 raw listings in 26 text columns, a third of them copies but for their ids.

    Holds malformed numbers, nulls in required and in other columns, makes and
    transmissions outside the lists, years at the limits, and 60 regions and
    models with equal counts across the cut at 50.
    """
    rows = spark.range(2400).select(
        F.col("id").alias("row"),
        # Rows 1600 and up repeat rows 0 to 799.
        F.when(F.col("id") >= 1600, F.col("id") - 1600).otherwise(F.col("id")).alias("id"),
    )
    # Two regions and two models per eight rows of the cycle are frequent, the others tie.
    cycle = F.pmod(F.col("id"), F.lit(120))
    region = F.when(cycle < 20, "metro").otherwise(F.concat(F.lit("r"), F.pmod(cycle, F.lit(59))))
    model = F.when(cycle < 30, "sedan one").otherwise(F.concat(F.lit("m"), F.pmod(cycle, F.lit(59))))
    spread = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40000))
    price = F.when(F.col("id") % 50 == 7, F.lit("x")).when(F.col("id") % 50 == 8, F.lit("9999999")).otherwise(
        spread.cast("string")
    )
    miles = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(200000)).cast("string")
    odometer = F.when(F.col("id") % 60 == 9, F.lit("5000000")).otherwise(miles)
    plain = pick(3, "1996", "1997", "2005", "2012.0", "2015", "2018", "2020", "2022", "x", "")
    return rows.select(
        *[
            F.concat(F.lit(f"{n}-"), F.col("row")).alias(n)
            for n in ("id", "url", "region_url", "VIN", "image_url", "description", "county",
                      "lat", "long", "posting_date", "size", "state")
        ],
        price.alias("price"),
        F.when(F.col("id") % 37 == 5, None).otherwise(plain).alias("year"),
        odometer.alias("odometer"),
        F.when(F.col("id") % 41 == 3, None)
        .otherwise(pick(4, "kia", "ford", "toyota", "bmw", "lada", "tesla"))
        .alias("manufacturer"),
        model.alias("model"),
        pick(5, "good", "fair", None, "new").alias("condition"),
        pick(6, "6 cylinders", "4 cylinders", None).alias("cylinders"),
        pick(7, "gas", "gas", "diesel").alias("fuel"),
        pick(8, "clean", "rebuilt").alias("title_status"),
        pick(9, "automatic", "manual", "other", "in the back seat").alias("transmission"),
        pick(10, "fwd", "4wd", None).alias("drive"),
        pick(11, "SUV", "sedan", None).alias("type"),
        pick(12, "white", "black", None).alias("paint_color"),
        region.alias("region"),
    )
