"""Transforms as pyspark.ml stages."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.sql import DataFrame

from loomwright.operators import get


class StepModel(Model):
    def __init__(self, op: str, params: dict, state: dict):
        super().__init__()
        self.op, self.given, self.state = op, params, state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return get(self.op).apply(dataset, self.given, self.state)


class Step(Estimator):
    def __init__(self, op: str, **params):
        super().__init__()
        get(op).params(params)
        self.op, self.given = op, params

    def _fit(self, dataset: DataFrame) -> StepModel:
        return StepModel(self.op, self.given, get(self.op).fit(dataset, self.given))


def pipeline(steps: list[dict]) -> Pipeline:
    return Pipeline(stages=[Step(s["op"], **s.get("params", {})) for s in steps])
