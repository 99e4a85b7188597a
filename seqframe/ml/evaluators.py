"""H7: named scorers as ``pyspark.ml`` Evaluators.

``r2, rmse (alias mse), pearson/per, spearman/spr, acc/accuracy``. Each
evaluation is one distributed aggregation (Spearman: bucketed average ranks)
returning a single number; ``isLargerBetter`` tells the search which way to go.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from seqframe.operators import metrics as mt


class MetricEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    metricName = Param(Params._dummy(), "metricName", "scorer name", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metricName: str = "spearman", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(metricName="spearman", labelCol="label", predictionCol="prediction")
        kwargs = self._input_kwargs
        self._set(**kwargs)
        if self.getMetricName() not in mt.SCORERS:
            raise ValueError(f"unknown scorer {self.getMetricName()!r}; expected one of {sorted(mt.SCORERS)}")

    def getMetricName(self) -> str:
        return self.getOrDefault(self.metricName)

    def _evaluate(self, dataset: DataFrame) -> float:
        y, p = self.getLabelCol(), self.getPredictionCol()
        d = dataset.select(y, p)
        v = mt.score(d, self.getMetricName(), y, p, out="v").first()["v"]
        return float("nan") if v is None else float(v)

    def isLargerBetter(self) -> bool:
        return mt.SCORERS[self.getMetricName()][1]


def scorer(name: str, labelCol: str = "label", predictionCol: str = "prediction") -> MetricEvaluator:
    """H7: evaluator for a scorer name; unknown names raise."""
    return MetricEvaluator(metricName=name, labelCol=labelCol, predictionCol=predictionCol)
