"""A5: z-scoring with the population standard deviation.

``pyspark.ml.feature.StandardScaler`` divides by the sample std and does not
centre by default; this estimator centres and divides by the population std
(zero-variance dimensions divide by 1), fitted on the training rows only.
Fitting is one Summarizer aggregation; the fitted mean/std are d numbers
applied with ``zip_with`` in generated code.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _ScalerParams(HasInputCol, HasOutputCol):
    pass


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Input: ARRAY<FLOAT|DOUBLE> or ML vector column. Output: ARRAY<DOUBLE>."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        c = self.getInputCol()
        dtype = df.schema[c].dataType.simpleString()
        v = F.col(c) if dtype == "vector" else array_to_vector(F.col(c).cast("array<double>"))
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).first()["s"]
        n = float(s["count"])
        mean = [float(x) for x in s["mean"]]
        var = [float(x) * (n - 1.0) / n if n > 0 else 0.0 for x in s["variance"]]
        std = [x ** 0.5 if x > 0 else 1.0 for x in var]
        m = PopulationScalerModel(inputCol=c, outputCol=self.getOutputCol())
        m._set(mean=mean, std=std)
        return m


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "per-dimension mean", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "per-dimension population std (0 -> 1)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.getInputCol()
        dtype = df.schema[c].dataType.simpleString()
        x = vector_to_array(F.col(c)) if dtype == "vector" else F.col(c).cast("array<double>")
        mu = F.array(*[F.lit(v) for v in self.getOrDefault(self.mean)])
        sd = F.array(*[F.lit(v) for v in self.getOrDefault(self.std)])
        ms = F.arrays_zip(mu.alias("m"), sd.alias("s"))
        z = F.zip_with(x, ms, lambda xi, p: (xi - p["m"]) / p["s"])
        return df.withColumn(self.getOutputCol(), z)


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """ARRAY<DOUBLE> -> ML vector, as a persistable pipeline stage."""

    @keyword_only
    def __init__(self, *, inputCol: str = "scaled", outputCol: str = "features_vec"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))
