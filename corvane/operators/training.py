"""Training curves and losses as windows over steps. A run's history is a bounded series per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def early_stop(history: DataFrame, patience: int, by: str = "run", step: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """by, stop, best: the first epoch at which `patience` epochs went without a new least loss (null if none), and the best epoch up to there."""
    past = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    least = history.withColumn("__before", F.min(loss).over(earlier))
    marks = least.withColumn("__best", F.max(F.when(F.col("__before").isNull() | (F.col(loss) < F.col("__before")), F.col(step))).over(past))
    stops = marks.groupBy(by).agg(F.min(F.when(F.col(step) - F.col("__best") >= patience, F.col(step))).alias("stop"))
    until = marks.join(stops, by).where(F.col("stop").isNull() | (F.col(step) <= F.col("stop")))
    return until.groupBy(by).agg(F.first("stop").alias("stop"), F.max("__best").alias("best"))


def exploded(history: DataFrame, factor: float = 4.0, after: int = 10, by: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """by, stop: the first step after `after` whose loss is over `factor` times the least so far."""
    past = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = history.withColumn("__least", F.min(loss).over(past))
    return marks.groupBy(by).agg(F.min(F.when((F.col(step) > after) & (F.col(loss) > factor * F.col("__least")), F.col(step))).alias("stop"))


def suggested_rate(history: DataFrame, smoothing: int = 5, by: str = "run", step: str = "step", rate: str = "lr", loss: str = "loss") -> DataFrame:
    """by, lr: where the smoothed loss falls fastest along log10(lr); the middle rate of runs under smoothing + 2 steps.

    The mean of `smoothing` losses from a step on goes with that step's rate.

    The slope between uneven points weighs both neighbours by the squares of the other's distance; at the
    ends it is the difference to the only neighbour.
    """
    order = Window.partitionBy(by).orderBy(step)
    size = Window.partitionBy(by)
    ahead = order.rowsBetween(0, smoothing - 1)
    rows = history.select(by, step, rate, F.count("*").over(size).alias("n"), F.row_number().over(order).alias("i"), F.avg(loss).over(ahead).alias("y"), F.log10(rate).alias("x"), F.col(rate).alias("at"))
    smooth = rows.where(F.col("i") <= F.col("n") - smoothing + 1)
    x0, x1, x2 = F.lag("x").over(Window.partitionBy(by).orderBy("i")), F.col("x"), F.lead("x").over(Window.partitionBy(by).orderBy("i"))
    y0, y1, y2 = F.lag("y").over(Window.partitionBy(by).orderBy("i")), F.col("y"), F.lead("y").over(Window.partitionBy(by).orderBy("i"))
    a, b = x1 - x0, x2 - x1
    inner = (a * a * y2 + (b * b - a * a) * y1 - b * b * y0) / (a * b * (a + b))
    slope = F.when(x0.isNull(), (y2 - y1) / b).when(x2.isNull(), (y1 - y0) / a).otherwise(inner)
    steep = smooth.withColumn("g", slope).groupBy(by).agg(F.min_by("at", F.struct("g", "i")).alias("steepest"))
    middle = rows.groupBy(by).agg(F.max("n").alias("n"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col(rate))).alias("middle"))
    return middle.join(steep, by, "left").select(by, F.when(F.col("n") < smoothing + 2, F.col("middle")).otherwise(F.coalesce("steepest", "middle")).alias("lr"))


def distillation_loss(rows: DataFrame, alpha: float = 0.5, temperature: float = 3.0, by: str = "id") -> DataFrame:
    """by, loss from rows (by, class, y, student, teacher): (1 - alpha) cross-entropy + alpha T² KL of the softened outputs."""
    tops = rows.groupBy(by).agg(F.max("student").alias("ms"), F.max("teacher").alias("mt"))
    each = rows.join(tops, by)
    s, t = F.col("student") - F.col("ms"), F.col("teacher") - F.col("mt")
    sums = each.groupBy(by).agg(
        F.sum(F.exp(s)).alias("z1"), F.sum(F.exp(s / temperature)).alias("zs"), F.sum(F.exp(t / temperature)).alias("zt"), F.sum(F.col("y") * s).alias("ys"), F.sum("y").alias("yn"),
        F.sum(F.exp(t / temperature) * (t - s) / temperature).alias("cross"),
    )
    entropy = F.col("yn") * F.ln("z1") - F.col("ys")
    divergence = F.col("cross") / F.col("zt") + F.ln("zs") - F.ln("zt")
    return sums.select(by, ((1 - alpha) * entropy + alpha * temperature**2 * divergence).alias("loss"))


def best_trial(trials: DataFrame, by: str = "trial", value: str = "val_roc_auc", params: str = "params") -> DataFrame:
    """One row: the trial of the largest value over its epochs, the first in ties, with its parameters as JSON."""
    top = trials.groupBy(by).agg(F.max(value).alias("best"), F.first(params).alias("params"))
    return top.agg(F.max_by(F.struct(by, "best", "params"), F.struct("best", (-F.col(by)).alias("first"))).alias("x")).select("x.*")
