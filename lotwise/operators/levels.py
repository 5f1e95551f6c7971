"""Levels of categorical columns as a table, for any number of levels.

A level's index is its rank by falling count, then by value. Ranks come from a
distributed sort: each task numbers its own levels, and the levels in the tasks
before are added, one number for each task and column. The table is written
with one folder for each column, saved with the model, and joined to rows:
Spark broadcasts a column's levels below its threshold, and beyond that splits
a hot value on the side of the rows. The driver gets the number of levels of a
column and never a level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.profile import value_tallies
from lotwise.operators.ranks import rank_levels
from lotwise.sources.workspace import new_path, scope

TABLE = "value string, level long"
#: Key of a column's metadata under which an assembled vector says what its slots are.
SLOTS = "slots"


class LevelIndexer(Estimator, HasInputCols, HasOutputCols):
    """Learns the levels of all its columns from one pass over the rows.

    Values of any kind are levels by their text. Null is no level.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LevelIndexerModel":
        spark, names = dataset.sparkSession, self.getInputCols()
        path = new_path(spark, "level-table")
        places = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])
        with scope(spark):
            texts = dataset.select(*[F.col(n).cast("string").alias(n) for n in names])
            tallies = value_tallies(texts, names).where(F.col("value").isNotNull())
            ranked = rank_levels(tallies.select(places[F.col("column_name")].alias("at"), "value", "count"))
            ranked.select("at", "value", "level").write.partitionBy("at").parquet(path)
            written = spark.read.schema(f"{TABLE}, at int").parquet(path)
            found = dict(map(tuple, written.groupBy("at").agg(F.count(F.lit(1))).collect()))
        sizes = [found.get(i, 0) for i in range(len(names))]
        model = LevelIndexerModel(inputCols=names, outputCols=self.getOutputCols(), sizes=sizes)
        return model._of(spark, path)


class LevelIndexerModel(Model, HasInputCols, HasOutputCols, MLWritable, MLReadable):
    """Adds each column's level as a number; unseen values and null get the number of levels.

    The table that it joins was written by the fit and goes with the session; a
    saved model has its own copy, so a loaded one does not need the session that fitted it.
    """

    sizes = Param(Params._dummy(), "sizes", "levels of each column", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, sizes=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self._tables: list[DataFrame | None] = []

    def _of(self, spark: SparkSession, path: str) -> "LevelIndexerModel":
        self._tables = [
            spark.read.schema(TABLE).parquet(f"{path}/at={i}") if size else None
            for i, size in enumerate(self.getOrDefault(self.sizes))
        ]
        return self

    def levels(self, name: str) -> DataFrame | None:
        """``value`` and ``level`` of a column; None where it had no value."""
        return self._tables[self.getInputCols().index(name)]

    def copy(self, extra=None) -> "LevelIndexerModel":
        other = super().copy(extra)
        other._tables = self._tables
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        joined, found = dataset, []
        for i, (name, out) in enumerate(zip(self.getInputCols(), self.getOutputCols())):
            size, table, level = self.getOrDefault(self.sizes)[i], self._tables[i], F.lit(0)
            if table is not None:
                side = table.select(F.col("value").alias(f"_value_{self.uid}_{i}"), F.col("level").alias(f"_level_{self.uid}_{i}"))
                joined = joined.join(side, F.col(name).cast("string") == F.col(f"_value_{self.uid}_{i}"), "left")
                level = F.coalesce(F.col(f"_level_{self.uid}_{i}"), F.lit(size))
            nominal = {"ml_attr": {"type": "nominal", "name": out, "num_vals": size + 1}}
            found.append(level.cast("double").alias(out, metadata=nominal))
        return joined.select(*dataset.columns, *found)

    def write(self) -> "_LevelWriter":
        return _LevelWriter(self)

    @classmethod
    def read(cls) -> "_LevelReader":
        return _LevelReader(cls)


class _LevelWriter(MLWriter):
    def __init__(self, instance: LevelIndexerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, table in enumerate(self.instance._tables):
            if table is not None:
                table.write.parquet(f"{path}/levels/at={i}")


class _LevelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LevelIndexerModel:
        model = self.cls()
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        return model._of(self.sparkSession, f"{path}/levels")


def _sizes(dataset: DataFrame, names: Sequence[str]) -> list[int]:
    """Levels of each index column, as its metadata says."""
    return [dataset.schema[n].metadata["ml_attr"]["num_vals"] - 1 for n in names]


def slot_vector(numbers: Column, width: int, slots: Sequence[Column], size: int) -> Column:
    """A sparse vector: ``width`` numbers first, then a 1 in each of ``slots`` that is not null; they rise.

    Built for a whole Arrow batch at a time. Each slot is a column of its own, as making
    lists of them without nulls takes Spark longer than the batch takes here.
    """

    def build(numbers: pa.Array, *slots: pa.Array) -> pa.Array:
        n, every = len(numbers), width + len(slots)
        at, values = np.empty((n, every), np.int32), np.ones((n, every))
        at[:, :width] = np.arange(width)
        values[:, :width] = numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        for j, slot in enumerate(slots, width):
            at[:, j] = slot.fill_null(-1).to_numpy(zero_copy_only=False)
        there = at >= 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[there])) for v in (at, values)]
        kinds = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32))]
        return pa.StructArray.from_arrays([*kinds, *lists], ["type", "size", "indices", "values"])

    return F.arrow_udf(build, VectorUDT())(numbers, *slots)


class SlotEncoder(Estimator, HasInputCols, HasOutputCols):
    """Index columns to sparse 0/1 vectors; how many slots is known from the indexer."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SlotEncoderModel":
        names = self.getInputCols()
        return SlotEncoderModel(inputCols=names, outputCols=self.getOutputCols(), sizes=_sizes(dataset, names))


class SlotEncoderModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One slot for each level; the index after the last is all zeros."""

    sizes = Param(Params._dummy(), "sizes", "levels of each column", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, sizes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        none = F.array().cast("array<double>")
        made = {}
        for name, out, size in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.sizes)):
            made[out] = slot_vector(none, 0, [_slot(name, size, 0)], size)
        return dataset.withColumns(made)


def _slot(name: str, size: int, offset: int) -> Column:
    return F.when(F.col(name) < size, F.col(name).cast("int") + F.lit(offset).cast("int"))


class SlotAssembler(Estimator, HasInputCols, HasOutputCol):
    """A vector of numbers and index columns to one sparse vector."""

    numbers = Param(Params._dummy(), "numbers", "column of the vector of numbers, or empty", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "numbers in that vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, numbers="", width=0):
        super().__init__()
        self._setDefault(numbers="", width=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SlotAssemblerModel":
        names = self.getInputCols()
        return SlotAssemblerModel(
            inputCols=names, outputCol=self.getOutputCol(), sizes=_sizes(dataset, names),
            numbers=self.getOrDefault(self.numbers), width=self.getOrDefault(self.width),
        )


class SlotAssemblerModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers come first, then a slot for each level of each column, in order.

    The vector's metadata says how many of both there are and where each column's
    slots start, not a word for each slot; ``binary_slots`` makes of it what trees ask for.
    """

    sizes = Param(Params._dummy(), "sizes", "levels of each column", TypeConverters.toListInt)
    numbers = Param(Params._dummy(), "numbers", "column of the vector of numbers, or empty", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "numbers in that vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, sizes=None, numbers="", width=0):
        super().__init__()
        self._setDefault(numbers="", width=0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, sizes, width = self.getInputCols(), self.getOrDefault(self.sizes), self.getOrDefault(self.width)
        column = self.getOrDefault(self.numbers)
        values = vector_to_array(column) if column else F.array().cast("array<double>")
        offsets = np.concatenate([[width], width + np.cumsum(sizes, dtype=np.int64)]).tolist()
        vector = slot_vector(values, width, [_slot(*s) for s in zip(names, sizes, offsets)], offsets[-1])
        told = {SLOTS: {"numbers": width, "size": offsets[-1], "starts": offsets[:-1]}}
        return dataset.withColumn(self.getOutputCol(), vector).withMetadata(self.getOutputCol(), told)


def binary_slots(df: DataFrame, name: str) -> DataFrame:
    """Say of each slot of an assembled vector that it is 0 or 1, so that trees split it as a category.

    Without it they would look for thresholds in a sample of the rows, where a
    rare level may not be. It takes an entry for each slot, on the driver; trees
    take more than that for each slot themselves.
    """
    told = df.schema[name].metadata.get(SLOTS)
    if told is None:
        return df
    attributes = {
        "numeric": [{"idx": i} for i in range(told["numbers"])],
        "binary": [{"idx": i} for i in range(told["numbers"], told["size"])],
    }
    kept = {kind: entries for kind, entries in attributes.items() if entries}
    return df.withMetadata(name, {"ml_attr": {"attrs": kept, "num_attrs": told["size"]}})
