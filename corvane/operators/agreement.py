"""How far two sets of outputs agree, weight quantization, and layer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import arrays

# Layer types by what runs on the device, those that need care, and those with weights to quantize.
SUPPORTED = [
    "Conv2D", "DepthwiseConv2D", "Dense", "BatchNormalization", "ReLU", "Add", "Multiply", "GlobalAveragePooling2D", "AveragePooling2D", "MaxPooling2D",
    "Reshape", "Flatten", "Concatenate", "ZeroPadding2D", "Dropout", "SpatialDropout2D", "Activation", "Softmax", "Sigmoid", "InputLayer",
]
CAREFUL = ["Lambda", "LSTM", "GRU", "SimpleRNN", "Bidirectional", "MultiHeadAttention", "LayerNormalization", "GroupNormalization"]
INPUTS = ["InputLayer"]
QUANTIZABLE = ["Conv2D", "DepthwiseConv2D", "Dense"]


def compared(left: DataFrame, right: DataFrame, key: str = "id", values: str = "values") -> DataFrame:
    """key, cosine, pearson, mse, mae of the arrays of rows with equal keys."""
    other = right.select(key, F.col(values).alias("__b"))
    a, b = arrays.doubles(F.col(values)), arrays.doubles(F.col("__b"))
    apart = F.zip_with(a, b, lambda x, y: x - y)
    return left.join(other, key).select(
        key, arrays.cosine(a, b).alias("cosine"), arrays.pearson(a, b).alias("pearson"), arrays.mean(apart, lambda d: d * d).alias("mse"), arrays.mean(apart, F.abs).alias("mae")
    )


def agreement_summary(each: DataFrame) -> DataFrame:
    """metric, mean, std, min, max of compared rows; with no rows 0 for likeness and infinity for errors."""
    kinds = {"cosine": 0.0, "mse": float("inf"), "mae": float("inf"), "pearson": 0.0}
    whole = each.agg(*(f(m).alias(f"{m}_{n}") for m in kinds for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.coalesce(F.col(f"{m}_{n}"), F.lit(v if n != "std" else 0.0)).alias(n) for n in ("mean", "std", "min", "max"))) for m, v in kinds.items()))
    return whole.select(F.inline(rows))


def worst_of_runs(runs: DataFrame) -> DataFrame:
    """metric, worst, mean of rows (run, metric, value): the least likeness, the largest error."""
    return runs.groupBy("metric").agg(F.when(F.first("metric").isin("cosine", "pearson"), F.min("value")).otherwise(F.max("value")).alias("worst"), F.avg("value").alias("mean"))


def quantization_gate(summary: DataFrame, least: float = 0.95) -> DataFrame:
    """`summary` with passed: whether the mean cosine reaches `least`."""
    return summary.where("metric = 'cosine'").select(F.col("mean").alias("cosine"), (F.col("mean") >= least).alias("passed"))


def unsupported_layers(layers: DataFrame) -> DataFrame:
    """name, layer_type, status of layers that are not known to be supported; `care` for those known to need it; input layers do not count."""
    kind = F.col("layer_type")
    return layers.where(~kind.isin(INPUTS) & ~kind.isin(SUPPORTED)).select("name", "layer_type", F.when(kind.isin(CAREFUL), "care").otherwise("unsupported").alias("status"))


def quantizable_weights(weights: DataFrame) -> DataFrame:
    """Weights of trainable layers of the types that are quantized, without biases and the frontend's."""
    return weights.where(F.col("layer_type").isin(QUANTIZABLE) & F.col("trainable") & ~F.startswith("name", F.lit("audio_frontend")) & ~F.endswith("name", F.lit("/bias")))


def macs(kind: Column, height: Column, width: Column, out: Column, kernel: Column, into: Column) -> Column:
    """Multiplications of a layer: convolution, depthwise convolution, dense; 0 for others."""
    return F.when(kind == "Conv2D", height * width * out * kernel * kernel * into).when(kind == "DepthwiseConv2D", height * width * out * kernel * kernel).when(kind == "Dense", into * out).otherwise(0).cast("long")


def params(kind: Column, out: Column, kernel: Column, into: Column) -> Column:
    """Weights and biases of a layer."""
    return F.when(kind == "Conv2D", kernel * kernel * into * out + out).when(kind == "DepthwiseConv2D", kernel * kernel * out + out).when(kind == "Dense", into * out + out).otherwise(0).cast("long")


def profile_totals(layers: DataFrame) -> DataFrame:
    """Sums of params, macs and activation bytes, and sizes in KB of four-byte and one-byte weights."""
    return layers.agg(
        F.sum("params").alias("params"), F.sum("macs").alias("macs"), F.sum("activation_bytes").alias("activation_bytes"), (F.sum("params") * 4 / 1024).alias("float_kb"), (F.sum("params") / 1024).alias("int8_kb"), F.max("activation_bytes").alias("peak_bytes")
    )
