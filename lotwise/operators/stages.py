"""Cleaning steps that learn from data, as pipeline stages that can be saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.predicates import filter_open_range
from lotwise.operators.clean import OTHERS, keep_listed, quantile_fence
from lotwise.operators.profile import top_k_values
from lotwise.sources.workspace import materialize


class _RareParams(HasInputCols):
    k = Param(Params._dummy(), "k", "values to keep in each column", TypeConverters.toListInt)
    other = Param(Params._dummy(), "other", "text for the rest", TypeConverters.toString)


class RareGrouper(Estimator, _RareParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the ``k`` most frequent values of each column; lists of any length stay in Spark."""

    @keyword_only
    def __init__(self, *, inputCols=None, k=None, other=OTHERS):
        super().__init__()
        self._setDefault(other=OTHERS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RareGrouperModel":
        names = self.getInputCols()
        lists = [top_k_values(dataset, n, k).select(n) for n, k in zip(names, self.getOrDefault(self.k))]
        model = RareGrouperModel(inputCols=names, other=self.getOrDefault(self.other))
        return model.keeping([materialize(_values(listed), "kept") for listed in lists])


def _values(listed: DataFrame) -> DataFrame:
    """The only column of a list as text, without null."""
    value = F.col(listed.columns[0]).cast("string").alias("value")
    return listed.select(value).where(F.col("value").isNotNull())


class RareGrouperModel(Model, HasInputCols, MLWritable, MLReadable):
    """Replaces every value outside the learned lists, null included.

    The lists are tables of one column, joined to the rows and saved with the model.
    """

    other = Param(Params._dummy(), "other", "text for the rest", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, other=OTHERS):
        super().__init__()
        self._setDefault(other=OTHERS)
        self._set(**self._input_kwargs)
        self._lists: list[DataFrame] = []

    def keeping(self, lists: Sequence[DataFrame]) -> "RareGrouperModel":
        """Use one list of values for each column, each value there once."""
        self._lists = list(lists)
        return self

    def kept(self, name: str) -> DataFrame:
        """The list of a column, as ``value``."""
        return self._lists[self.getInputCols().index(name)]

    def copy(self, extra=None) -> "RareGrouperModel":
        return super().copy(extra).keeping(self._lists)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for name, listed in zip(self.getInputCols(), self._lists):
            dataset = keep_listed(dataset, name, listed.withColumnRenamed("value", name), self.getOrDefault(self.other))
        return dataset

    def write(self) -> "_RareWriter":
        return _RareWriter(self)

    @classmethod
    def read(cls) -> "_RareReader":
        return _RareReader(cls)


class _RareWriter(MLWriter):
    def __init__(self, instance: RareGrouperModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, listed in enumerate(self.instance._lists):
            listed.write.parquet(f"{path}/kept/{i}")


class _RareReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> RareGrouperModel:
        model, metadata = self.cls(), DefaultParamsReader.loadMetadata(path, self.sparkSession)
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        reader = self.sparkSession.read.schema("value string")
        return model.keeping([reader.parquet(f"{path}/kept/{i}") for i in range(len(model.getInputCols()))])


class _FenceParams(HasInputCol):
    lower = Param(Params._dummy(), "lower", "quantile of the lower fence", TypeConverters.toFloat)
    qLo = Param(Params._dummy(), "qLo", "lower quantile of the spread", TypeConverters.toFloat)
    qHi = Param(Params._dummy(), "qHi", "upper quantile of the spread", TypeConverters.toFloat)
    factor = Param(Params._dummy(), "factor", "spreads above the upper quantile", TypeConverters.toFloat)
    relErr = Param(Params._dummy(), "relErr", "quantile error, 0 for exact", TypeConverters.toFloat)


class QuantileTrimmer(Estimator, _FenceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns an outlier fence on one column."""

    @keyword_only
    def __init__(self, *, inputCol=None, lower=0.05, qLo=0.25, qHi=0.75, factor=1.5, relErr=0.01):
        super().__init__()
        self._setDefault(lower=0.05, qLo=0.25, qHi=0.75, factor=1.5, relErr=0.01)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "QuantileTrimmerModel":
        fence = quantile_fence(
            dataset,
            self.getInputCol(),
            self.getOrDefault(self.lower),
            self.getOrDefault(self.qLo),
            self.getOrDefault(self.qHi),
            self.getOrDefault(self.factor),
            self.getOrDefault(self.relErr),
        )
        if fence is None:
            raise ValueError(f"no values in {self.getInputCol()}")
        return QuantileTrimmerModel(inputCol=self.getInputCol(), fence=list(fence))


class QuantileTrimmerModel(Model, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps rows strictly inside the learned fence."""

    fence = Param(Params._dummy(), "fence", "low and high end", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, fence=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return filter_open_range(dataset, self.getInputCol(), *self.getOrDefault(self.fence))
