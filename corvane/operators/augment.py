"""Augmentation with given or seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays
from corvane.operators.catalog import order_key


#: Rows about that are mixed among each other, and the chance that no attempt at drawing gains succeeds.
BATCH_ROWS, FAILING = 256, 1e-9


def uniform(key: Column, *tags: Column | str, seed: int = 42) -> Column:
    """A number between 0 and 1 from a key, tags and a seed, by a digest: any engine and any partitioning give the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.lit(t) if isinstance(t, str) else t.cast("string") for t in tags), key.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 2.0**32


def dirichlet(key: Column, n: Column, alpha: float, seed: int = 42, most: int = 3) -> Column:
    """`n` gains, `most` at most, that add up to 1, from a symmetric Dirichlet distribution.

    Powers u^(1/alpha) of uniform numbers whose sum is at most 1, divided by it, have that distribution. Attempts are
    made until one fits; equal gains are left for the case, rarer than FAILING, that none does.
    """
    fits = min(math.exp(k * math.lgamma(alpha + 1) - math.lgamma(k * alpha + 1)) for k in range(2, most + 1))
    attempts = max(1, math.ceil(math.log(FAILING) / math.log1p(-fits))) if fits < 1 else 1

    def attempt(a: Column) -> Column:
        x = F.transform(F.sequence(F.lit(1), n), lambda j: F.pow(uniform(key, "gain", a, j, seed=seed), F.lit(1 / alpha)))
        return arrays.element_of(x, lambda v: F.struct(v.alias("x"), arrays.total(v).alias("t")))

    drawn = F.filter(F.transform(F.sequence(F.lit(1), F.lit(attempts)), attempt), lambda d: (d["t"] <= 1) & (d["t"] > 0))
    first = arrays.element_of(F.get(drawn, F.lit(0)), lambda d: F.transform(d["x"], lambda v: v / d["t"]))
    return F.coalesce(first, F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(1.0) / n))


def mix_partners(samples: DataFrame, probability: float = 0.25, alpha: float = 0.2, seed: int = 42, key: str = "id", batch: int = BATCH_ROWS) -> DataFrame:
    """(key, partner, gain): a share of `probability` of each batch's rows, with one or two other places of the batch each, and
    gains that add up to 1. Rows are dealt to batches of about `batch` by a digest of the key and numbered there: keys may have gaps."""
    if probability <= 0 or alpha <= 0:
        return samples.select(key, F.col(key).alias("partner"), F.lit(1.0).alias("gain")).limit(0)
    batches = max(1, -(-samples.count() // batch))
    own = Window.partitionBy("batch")
    rows = samples.select(F.col(key), F.floor(uniform(F.col(key), "batch", seed=seed) * batches).alias("batch"))
    rows = rows.select(key, "batch", F.row_number().over(own.orderBy(uniform(F.col(key), "order", seed=seed), key)).alias("place"), F.count("*").over(own).alias("m"))
    draw = lambda tag, n: F.floor(uniform(F.col(key), tag, seed=seed) * n)
    n = F.when(uniform(F.col(key), "sources", seed=seed) < 0.5, 2).otherwise(3)
    chosen = rows.where(F.col("place") <= F.floor(F.col("m") * probability)).select(key, "batch", "place", "m", F.least(n, F.col("m") + 1).cast("int").alias("n"), draw("first", F.col("m")).alias("p"))
    second = (F.col("p") + 1 + draw("second", F.col("m") - 1)) % F.col("m")
    places = F.slice(F.array(F.col("place").cast("long"), F.col("p") + 1, second + 1), F.lit(1), F.col("n"))
    wanted = chosen.select(key, "batch", F.explode(F.arrays_zip(places.alias("place"), dirichlet(F.col(key), F.col("n"), alpha, seed).alias("gain"))).alias("w"))
    found = wanted.select(key, "batch", F.col("w.place").alias("place"), F.col("w.gain").alias("gain")).join(rows.select("batch", F.col("place").cast("long").alias("place"), F.col(key).alias("partner")), ["batch", "place"])
    return found.groupBy(key, "partner").agg(F.sum("gain").alias("gain"))


def mixed(samples: DataFrame, partners: DataFrame, key: str = "id", smoothing: float = 0.0) -> DataFrame:
    """Rows (key, samples, y) where rows of `partners` (key, partner, gain) name the rows to mix: the sum of gain times samples and
    the largest of the labels, from the original rows; rows without partners stay. Labels of all rows are then smoothed."""
    sources = samples.select(F.col(key).alias("partner"), F.col("samples").alias("x"), F.col("y").alias("z"))
    # Two or three sources a row: few arrays are gathered, and none is taken apart.
    several = partners.join(sources, "partner").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("partner", "gain", "x", "z"))).alias("s"))
    weighed = lambda acc, s: F.zip_with(acc, s["x"], lambda a, v: F.coalesce(a, F.lit(0.0)) + F.coalesce(s["gain"] * v, F.lit(0.0)))
    either = lambda acc, s: F.zip_with(acc, s["z"], lambda a, v: F.greatest(a, v))
    none = F.array().cast("array<double>")
    done = several.select(key, F.aggregate("s", none, weighed).alias("samples"), F.aggregate("s", none, either).alias("y"))
    out = done.unionByName(samples.select(key, F.col("samples").cast("array<double>"), F.col("y").cast("array<double>")).join(partners.select(key).distinct(), key, "left_anti"))
    if smoothing <= 0:
        return out
    return out.withColumn("y", F.when(F.size("y") > 1, F.transform("y", lambda v: (1.0 - smoothing) * v + smoothing / F.size("y"))).otherwise(F.col("y")))


def masked_spectrum(rows: Column, masks: Column, axis: str) -> Column:
    """An array of arrays (bins of frames) with stretches zeroed: `masks` is an array of (start, width) along `freq` or `time`."""
    inside = lambda i: F.exists(masks, lambda m: (i >= m["start"]) & (i < m["start"] + m["width"]))
    if axis == "freq":
        return F.transform(rows, lambda r, i: F.when(inside(i), F.transform(r, lambda _: F.lit(0.0))).otherwise(r))
    return F.transform(rows, lambda r: F.transform(r, lambda x, j: F.when(inside(j), F.lit(0.0)).otherwise(x)))


def seeded_masks(key: Column, size: int, widest: int, n: int, seed: int = 42) -> Column:
    """`n` masks (start, width) narrower than `widest` within `size`, from the key and a seed."""
    def one(i: Column) -> Column:
        width = order_key(key * 31 + i, seed) % max(1, min(widest, size))
        start = order_key(key * 31 + i, seed + 1) % F.greatest(F.lit(1), F.lit(size) - width)
        return F.struct(start.cast("int").alias("start"), width.cast("int").alias("width"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)
