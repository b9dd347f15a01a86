"""Models that score batches, and registries of models and features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODELS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


@dataclass(frozen=True)
class Frontend:
    """What is known of a feature: whether it is worked out before the model, and whether the device takes it."""

    name: str
    precomputed: bool
    device: bool
    description: str = ""


FRONTENDS: dict[str, Frontend] = {}


def register_model(name: str):
    """Registers a function that makes a predict function (batch to scores); a name twice is an error."""
    def add(make):
        if name in MODELS:
            raise ValueError(f"model {name} is registered")
        MODELS[name] = make
        return make

    return add


def register_frontend(info: Frontend) -> None:
    if info.name in FRONTENDS:
        raise ValueError(f"frontend {info.name} is registered")
    FRONTENDS[info.name] = info


# The features there are.
for _f in (Frontend("librosa", True, False, "mel spectrogram"), Frontend("hybrid", False, True, "magnitudes, mixed by the model"), Frontend("raw", False, True, "samples"), Frontend("mfcc", True, False, "cepstra"), Frontend("log_mel", True, False, "log mel spectrogram")):
    register_frontend(_f)


def frontend_table(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.precomputed, f.device) for f in sorted(FRONTENDS.values(), key=lambda f: f.name)]
    return spark.createDataFrame(rows, "frontend string, precomputed boolean, device boolean")


def scored(df: DataFrame, model: str, features: Column | str, width: int, into: str = "scores", batch: int = 64) -> DataFrame:
    """`df` with the model's scores of `features` (arrays of `width` elements), in batches."""
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    return df.withColumn(into, predict_batch_udf(MODELS[model], return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])(features))


def linear(weights: np.ndarray, bias: np.ndarray):
    """Makes a predict function: the logistic of a linear map."""
    def make():
        return lambda x: 1 / (1 + np.exp(-(x.astype(np.float64) @ weights + bias)))

    return make


def frontends_of(df: DataFrame, column: str = "frontend") -> DataFrame:
    """`df` with what is known of its frontend; an unknown one is an error."""
    found = df.join(F.broadcast(frontend_table(df.sparkSession)), column, "left")
    return found.withColumn("precomputed", F.when(F.col("precomputed").isNull(), F.raise_error(F.concat(F.lit("unknown frontend: "), F.coalesce(column, F.lit("null")))).cast("boolean")).otherwise(F.col("precomputed")))
