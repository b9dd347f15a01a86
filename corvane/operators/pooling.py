"""Chunk scores to file scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names each way of pooling goes by.
NAMES = {"avg": "average", "mean": "average", "average": "average", "max": "max", "lme": "lme", "log_mean_exp": "lme", "log_mean_exponential": "lme"}


def pool(scores: DataFrame, by: list[str], method: str = "average", beta: float = 10.0, score: str = "score") -> DataFrame:
    """`score` per group: the mean, the maximum, or the log of the mean of exponentials.

    The last needs the group's maximum first; both come from one aggregation over the collected maxima's
    difference, so the group is shuffled once: mean(exp(b s - m)) = mean(exp(b s)) / exp(m) would overflow
    for large scores, so the maximum is joined back.
    """
    way = NAMES.get(method.lower())
    if way is None:
        raise ValueError(f"unknown pooling: {method}")
    if way == "average":
        return scores.groupBy(*by).agg(F.avg(score).alias(score))
    if way == "max":
        return scores.groupBy(*by).agg(F.max(score).alias(score))
    top = scores.groupBy(*by).agg(F.max(beta * F.col(score)).alias("__m"))
    each = scores.join(top, by)
    return each.groupBy(*by).agg(((F.first("__m") + F.ln(F.avg(F.exp(beta * F.col(score) - F.col("__m"))) + 1e-12)) / beta).alias(score))


def pool_matrix(rows: Column, classes: int, method: str = "average", beta: float = 10.0) -> Column:
    """An array of equally long arrays pooled element by element; zeros if there is none."""
    way = NAMES.get(method.lower())
    if way is None:
        raise ValueError(f"unknown pooling: {method}")

    def one(i: Column) -> Column:
        own = F.transform(rows, lambda r: F.get(r, i))
        count = F.size(rows).cast("double")
        if way == "average":
            return F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / count
        if way == "max":
            return F.array_max(own)
        top = F.array_max(own) * beta
        return (top + F.ln(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(beta * x - top)) / count + 1e-12)) / beta

    return F.when(F.size(rows) == 0, F.array_repeat(F.lit(0.0), classes)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), one))


def attention(items: DataFrame, by: list[str], score: str = "score", value: str = "value") -> DataFrame:
    """The softmax of the scores as weights of the values, per group."""
    top = items.groupBy(*by).agg(F.max(score).alias("__m"))
    weight = F.exp(F.col(score) - F.col("__m"))
    return items.join(top, by).groupBy(*by).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))
