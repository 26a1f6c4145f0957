"""Fitted models of this library as pipeline stages: their numbers are one JSON parameter, so they are saved with any pipeline."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf


class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction`` to rows with ``features``, and ``probability`` in a classification.

    A subclass computes decision values, class chances and the prediction from a matrix, in Arrow batches.
    """

    state = Param(Params._dummy(), "state", "fitted numbers as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, state: dict | None = None):
        super().__init__()
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def numbers(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @staticmethod
    def outputs(numbers: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Predictions of the rows of ``x`` and, in a classification, the chance of each class."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers, outputs = self.numbers, type(self).outputs
        classify = numbers["kind"] == "classification"

        @pandas_udf("struct<p: double, c: array<double>>")
        def run(features: pd.Series) -> pd.DataFrame:
            x = np.vstack(features.to_numpy()) if len(features) else np.zeros((0, numbers["width"]))
            prediction, chances = outputs(numbers, x)
            return pd.DataFrame({"p": prediction, "c": list(chances) if classify else [None] * len(x)})

        out = dataset.withColumn("__out", run(vector_to_array("features")))
        added = {"prediction": F.col("__out.p")}
        if classify:
            added["probability"] = array_to_vector(F.col("__out.c"))
        return out.withColumns(added).drop("__out")


def matrix(column, width: int) -> np.ndarray:
    """A list column of an Arrow batch as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
