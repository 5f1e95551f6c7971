"""Ranks and lists of the most frequent values, for any number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise.sources.workspace import materialize


def rank_levels(tallies: DataFrame) -> DataFrame:
    """Add ``level`` to rows of ``at``, ``value`` and ``count``: the rank within ``at``, from 0.

    Gives a written table; open a ``scope`` to have it deleted.
    """
    # Ranges are sampled from the tallies first, so they are read twice.
    ordered = materialize(tallies, "tallies").orderBy("at", F.desc("count"), "value")
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "levels")
    task = F.shiftright("place", 33)
    parts = placed.groupBy("at", task.alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    before = W.partitionBy("at").orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    starts = parts.select("at", "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start"))
    joined = placed.withColumn("task", task).join(starts, ["at", "task"])
    return joined.select("at", "value", "count", (F.col("place") + F.col("start")).alias("level"))


def most_frequent(counts: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` rows of ``name``, ``count`` with the largest counts, equal counts in value order.

    A threshold instead of a sort: how many values have each count tells the
    count at which the list is cut, and only values with just that count are
    ranked, by a distributed sort. No task and no driver holds the list. The driver gets
    one number for each different count, of which ``n`` rows have at most the root of
    ``2 n``. ``counts`` is written, as it is read twice.
    """
    counted = materialize(counts.select(name, "count"), "value-counts")
    taken, cut, wanted = 0, None, 0
    for count, values in counted.groupBy("count").agg(F.count(F.lit(1))).orderBy(F.desc("count")).collect():
        cut, wanted = count, min(values, k - taken)
        taken += wanted
        if taken >= k:
            break
    if cut is None or k <= 0:
        return counted.limit(0)
    above = counted.where(F.col("count") > cut)
    tied = counted.where(F.col("count") == cut).select(F.lit(0).alias("at"), F.col(name).alias("value"), "count")
    kept = rank_levels(tied).where(F.col("level") < wanted)
    return above.unionAll(kept.select(F.col("value").alias(name), "count"))
