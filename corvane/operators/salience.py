"""Which parts of a recording are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays
from corvane.operators import ranking

#: Points that the median of an activity ratio is taken over.
SUBSAMPLE = 512
#: A signal whose frames' energies are all below this is silent.
SILENCE = 1e-10


def median(values: Column) -> Column:
    """The middle of the sorted values, the mean of the two middle ones for an even number."""
    return arrays.element_of(
        F.array_sort(values),
        lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2.0,
    )


def percentile(values: Column, q: float) -> Column:
    """Linear interpolation between the sorted values."""
    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * q
        low = F.floor(place).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return a + (b - a) * (place - low)

    return arrays.element_of(F.array_sort(values), at)


def spread_sample(values: Column, most: int = SUBSAMPLE) -> Column:
    """At most `most` evenly spread elements, the first and the last among them."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(values, F.floor(i * (F.size(values) - 1) / (most - 1)).cast("int")))
    return F.when(F.size(values) <= most, values).otherwise(picked)


def activity_ratio(samples: Column, k: float = 2.0, most: float = 0.8, subsample: int = SUBSAMPLE) -> Column:
    """The share of samples whose size exceeds the median and k deviations; 0 if over `most` or without samples."""
    sizes = F.transform(samples, F.abs)
    spread = lambda v: median(F.transform(spread_sample(v, subsample), lambda x: F.abs(x)))

    def ratio(v: Column) -> Column:
        def beyond(m: Column) -> Column:
            deviation = median(F.transform(spread_sample(v, subsample), lambda x: F.abs(x - m)))
            return arrays.element_of(m + k * (deviation + 1e-10), lambda t: arrays.mean(v, lambda x: F.when(x > t, 1.0).otherwise(0.0)))

        return arrays.element_of(spread(v), beyond)

    share = arrays.element_of(sizes, ratio)
    return arrays.element_of(F.coalesce(share, F.lit(0.0)), lambda r: F.when(r > most, 0.0).otherwise(r))


def ranked_chunks(chunks: DataFrame, value: str, threshold: float, most: int | None = None, file: str = "file", chunk: str = "chunk_idx") -> DataFrame:
    """Chunks of each file by falling `value` (the later first in ties): those from the threshold on, one at least; `rank` from 1."""
    order = Window.partitionBy(file).orderBy(F.desc(value), F.desc(chunk))
    kept = chunks.withColumn("rank", F.row_number().over(order)).where((F.col(value) >= threshold) | (F.col("rank") == 1))
    return kept if most is None else kept.where(F.col("rank") <= most)


def relative(chunks: DataFrame, value: str, file: str = "file", floor: float = 1e-10) -> DataFrame:
    """`value` over the largest of the file."""
    top = F.max(value).over(Window.partitionBy(file))
    return chunks.withColumn(value, F.col(value) / (top + floor))


def picked(chunks: DataFrame, n: int, order: Column, first: Column | None = None, file: str = "file") -> DataFrame:
    """`n` chunks of each file in a given order, with `first` ones before all others."""
    keys = [order] if first is None else [F.when(first, 0).otherwise(1), order]
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy(file).orderBy(*keys))).where(F.col("rank") <= n)


def active_regions(frames: DataFrame, value: str, by: str, place: str, q: float = 0.75) -> DataFrame:
    """by, first, last, peak, peak_value: runs of frames at or over the group's percentile of `value`; the first peak counts."""
    limit = ranking.percentiles(frames, value, {"__limit": q}, [by])
    active = frames.join(limit, by).where(F.col(value) >= F.col("__limit"))
    island = F.col(place) - F.row_number().over(Window.partitionBy(by).orderBy(place))
    return active.withColumn("__island", island).groupBy(by, "__island").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.max_by(place, F.struct(value, (-F.col(place)).alias("p"))).alias("peak"), F.max(value).alias("peak_value")
    ).drop("__island")


def apart(starts: Column, distance: float | Column, most: int) -> Column:
    """Starts taken in the given order, leaving out those nearer than `distance` to one taken, up to `most`."""
    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) >= most) | F.exists(acc, lambda y: F.abs(y - x) < distance), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(starts, F.array().cast("array<int>"), step)


def crops(samples: Column, size: int, most: int = 5, q: float = 0.75) -> Column:
    """Starts of at most `most` chunks around the loudest places: frames at or over the percentile of energy form regions; chunks centre
    on where the regions' peak frames begin, by falling energy, not nearer than half a chunk (in whole samples). A silent signal gives
    its centre, a short one a single chunk at 0."""
    frame = max(1, min(1024, size // 4))
    hop = max(1, frame // 2)
    energy = arrays.short_time_energy(samples, frame, hop)

    def regions(e: Column) -> Column:
        def fold(limit: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                x = F.get(e, i)
                active = x >= limit
                going = acc["inside"]
                better = ~going | (x > acc["value"])
                opened = F.struct(active.alias("inside"), F.when(active, F.when(better, i).otherwise(acc["peak"])).otherwise(-1).alias("peak"), F.when(active, F.when(better, x).otherwise(acc["value"])).otherwise(0.0).alias("value"), F.when(going & ~active, F.array_append(acc["done"], F.struct((-acc["value"]).alias("loud"), acc["peak"].alias("at")))).otherwise(acc["done"]).alias("done"))
                return opened

            start = F.struct(F.lit(False).alias("inside"), F.lit(-1).alias("peak"), F.lit(0.0).alias("value"), F.array().cast("array<struct<loud:double,at:int>>").alias("done"))
            return F.aggregate(F.sequence(F.lit(0), F.size(e) - 1), start, step, lambda acc: F.when(acc["inside"], F.array_append(acc["done"], F.struct((-acc["value"]).alias("loud"), acc["peak"].alias("at")))).otherwise(acc["done"]))

        return arrays.element_of(percentile(e, q), fold)

    centred = F.transform(
        F.array_sort(arrays.element_of(energy, regions)),
        lambda r: F.greatest(F.lit(0), F.least(r["at"] * hop - size // 2, F.size(samples) - size)),
    )
    middle = F.array(F.greatest(F.lit(0), F.floor(F.size(samples) / 2).cast("int") - size // 2))
    silent = F.array_max(energy) < SILENCE
    return F.when(F.size(samples) <= size, F.array(F.lit(0))).when(silent, middle).otherwise(apart(centred, size // 2, most))
