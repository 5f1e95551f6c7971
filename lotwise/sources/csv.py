"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    multi_line: bool = False,
    quote: str = '"',
    escape: str = '"',
    mode: str = "PERMISSIVE",
    sampling_ratio: float = 1.0,
    empty_as_null: bool = True,
) -> DataFrame:
    """Scan a headed CSV.

    Give a ``schema`` for large inputs: inference reads the whole file once
    more. ``multi_line`` accepts line breaks inside quoted free text, but then
    a file can no longer be split among tasks. Empty text reads as null;
    without ``empty_as_null`` only a cell without quotes does.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", quote)
        .option("escape", escape)
        .option("mode", mode)
    )
    if not empty_as_null:
        # Stands for a cell with nothing in it, so that "" is not taken for one.
        reader = reader.option("nullValue", "\u0000")
    if schema is None:
        reader = reader.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    else:
        reader = reader.schema(schema)
    return reader.csv(path)


CORRUPT = "_corrupt"
_FILE, _BLOCK, _LINE = "_file", "_block", "_line"


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    quote: str = '"',
    empty_as_null: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that do not, with file, place and text.

    Every line of every file but its header is in one of the two frames, and both
    read the same split lines, so counts of both add up to the lines. A line
    is corrupt if it has too few or too many cells, a cell of another type than the
    schema's, or a quote that is not closed. Its place is the byte at which the block of the
    file that it was read in begins, and the line's number in the task of that block, from 0. Records are lines: a line break inside quotes makes corrupt lines
    of both its halves; read such files with ``read_csv`` and ``multi_line``. Empty lines
    are no records. Columns that are not null in the schema are read as nullable.
    """
    names = [f.name for f in schema.fields]
    if set(names) & {CORRUPT, _FILE, _BLOCK, _LINE}:
        raise ValueError(f"{CORRUPT}, {_FILE}, {_BLOCK} and {_LINE} are the reader's own names")
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    header = ",".join(names)
    plain = F.replace("line", F.lit(quote), F.lit(""))
    wanted = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{CORRUPT}` string"])
    options = {"quote": quote, "escape": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if not empty_as_null:
        options["nullValue"] = "\u0000"
    parsed = lines.where((F.trim("line") != "") & (plain != header)).select(
        "line", _FILE, "start", "place", F.from_csv("line", F.lit(wanted), options).alias("row")
    )
    # Quotes come in pairs, also those that stand for a quote in the text.
    odd = (F.length("line") - F.length(plain)) % 2 == 1
    bad = F.col(f"row.{CORRUPT}").isNotNull() | odd
    good = parsed.where(~bad).select(*[F.col(f"row.{n}").alias(n) for n in names])
    within = F.col("place") - F.shiftleft(F.shiftright("place", 33), 33)
    corrupt = parsed.where(bad).select(_FILE, F.col("start").alias(_BLOCK), within.alias(_LINE), F.col("line").alias(CORRUPT))
    return good, corrupt


def write_csv(
    df: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    max_records_per_file: int = 0,
    files: int | None = None,
) -> None:
    """Write headed CSV part files, one or more per task.

    The whole table is not funnelled through one task unless ``files`` asks for it;
    readers of the export take the folder. ``files`` is the number of files, to which rows are dealt
    evenly; a small export may ask for one. Quotes are doubled and blanks kept, so ``read_csv`` gives the
    text back.
    """
    (
        (df if files is None else df.repartition(files)).write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", max_records_per_file)
        .mode(mode)
        .csv(path)
    )
