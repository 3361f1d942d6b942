"""Median imputation with exact medians, as an ML stage that saves and loads."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalar import usable
from txrisk.operators.ordering import exact_quantiles


class ExactImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the linear-interpolation median of each input column.

    A column without a usable value is filled with zero.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactImputerModel:
        columns = self.getInputCols()
        found = exact_quantiles(dataset, columns, [0.5])
        medians = [found[(None, c)][0] if found.get((None, c)) else 0.0 for c in columns]
        return ExactImputerModel(inputCols=columns, outputCols=self.getOutputCols(), medians=medians)


class ExactImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "what replaces a missing value, by column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: list[str] | None = None,
        outputCols: list[str] | None = None,
        medians: list[float] | None = None,
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def surrogates(self) -> dict[str, float]:
        return dict(zip(self.getInputCols(), self.getOrDefault(self.medians), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians), strict=True)
        return dataset.select("*", *[F.coalesce(usable(c), F.lit(m)).alias(o) for c, o, m in filled])
