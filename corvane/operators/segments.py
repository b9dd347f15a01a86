"""Recordings longer than an array: rows (file, segment, samples), all segments of a file of one length but its last.

What looks across a cut gets it from its neighbours: halos by joins on (file, segment), the state of a recurrent
filter by composing each segment's step, medians from the few samples they are taken of, crops from the
energies of frames. No row or task holds a whole recording; per file there are only rows a segment, or a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays
from corvane.functions.spectral import smoothing
from corvane.operators import salience


def cut(signals: DataFrame, length: int, file: str = "file", samples: str = "samples") -> DataFrame:
    """Signals of arrays as segments: file, segment, samples."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(length))
    parts = F.transform(starts, lambda s: F.slice(samples, s + 1, F.lit(length)))
    return signals.where(F.size(samples) > 0).select(file, F.posexplode(parts).alias("segment", "samples"))


def lengths(segments: DataFrame, file: str = "file") -> DataFrame:
    """file, n: samples of each recording."""
    return segments.groupBy(file).agg(F.sum(F.size("samples").cast("long")).alias("n"))


def with_following(segments: DataFrame, halo: int, length: int, file: str = "file") -> DataFrame:
    """`segments` with up to `halo` samples of those behind: as many joins as segments that the halo reaches into."""
    out = segments.select(file, "segment", F.col("samples").alias("own"), "samples")
    for ahead in range(1, -(-halo // length) + 1):
        head = segments.select(F.col(file).alias("__f"), (F.col("segment") - ahead).alias("__s"), F.slice("samples", 1, min(length, halo - (ahead - 1) * length)).alias("__head"))
        joined = out.join(head, (F.col(file) == F.col("__f")) & (F.col("segment") == F.col("__s")), "left")
        out = joined.select(file, "segment", "own", F.concat("samples", F.coalesce("__head", F.array().cast("array<double>"))).alias("samples"))
    return out


def energies(segments: DataFrame, frame: int, hop: int, length: int, file: str = "file") -> DataFrame:
    """file, t, energy: mean squares of all full frames; a recording shorter than a frame is one frame."""
    rows = with_following(segments, frame - 1, length, file).join(lengths(segments, file), file)
    first = F.col("segment").cast("long") * length
    low = F.ceil(first / hop)
    last = F.least(F.floor((first + F.size("own") - 1) / hop), F.floor(F.greatest(F.col("n") - frame, F.lit(0)) / hop))
    frames = F.when(low <= last, F.sequence(low, last)).otherwise(F.array().cast("array<long>"))
    each = rows.select(file, "samples", first.alias("__first"), F.explode(frames).alias("t"))
    own = F.slice("samples", (F.col("t") * hop - F.col("__first") + 1).cast("int"), F.lit(frame))
    return each.select(file, "t", arrays.mean(own, lambda x: x * x).alias("energy"))


def activity(segments: DataFrame, length: int, k: float = 2.0, most: float = 0.8, subsample: int = salience.SUBSAMPLE, file: str = "file") -> DataFrame:
    """file, activity: as salience.activity_ratio of the whole. Medians are of the same evenly spread samples, looked up in their segments."""
    sizes = lengths(segments, file)
    places = F.when(F.col("n") <= subsample, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(subsample - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (subsample - 1))))
    wanted = sizes.select(file, F.explode(places).alias("place")).select(file, F.floor(F.col("place") / length).cast("int").alias("segment"), (F.col("place") % length + 1).cast("int").alias("at"))
    spread = wanted.groupBy(file, "segment").agg(F.collect_list("at").alias("at")).join(segments, [file, "segment"])
    picked = spread.select(file, F.explode(F.transform("at", lambda i: F.abs(F.element_at("samples", i)))).alias("v")).groupBy(file).agg(F.collect_list("v").alias("v"))  # SUBSAMPLE at most
    middle = picked.select(file, "v", salience.median(F.col("v")).alias("m"))
    limits = middle.select(file, (F.col("m") + k * (salience.median(F.transform("v", lambda x: F.abs(x - F.col("m")))) + 1e-10)).alias("limit"))
    over = segments.join(limits, file).groupBy(file).agg(F.sum(F.size(F.filter("samples", lambda x: F.abs(x) > F.col("limit"))).cast("long")).alias("over"), F.sum(F.size("samples").cast("long")).alias("n"))
    ratio = F.col("over") / F.col("n")
    return over.select(file, F.when(ratio > most, 0.0).otherwise(ratio).alias("activity"))


def crops(segments: DataFrame, length: int, size: int, most: int = 5, q: float = 0.75, file: str = "file") -> DataFrame:
    """file, starts: as salience.crops of the whole, from the energies of frames and their regions."""
    frame = max(1, min(1024, size // 4))
    hop = max(1, frame // 2)
    sizes = lengths(segments, file)
    frames = energies(segments, frame, hop, length, file)
    peaks = salience.active_regions(frames, "energy", file, "t", q).join(sizes, file)
    start = F.greatest(F.lit(0).cast("long"), F.least(F.col("peak") * hop - size // 2, F.col("n") - size))
    # A start taken leaves out those nearer than half a chunk: regions of so many frames on both sides.
    enough = most * (2 * (size // 2 // hop + 1) + 1)
    order = Window.partitionBy(file).orderBy(F.desc("peak_value"), "peak")
    loudest = peaks.select(file, "peak_value", "peak", start.cast("int").alias("start")).withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= enough)
    # Starts held to the ends of a recording are equal: they do not use the bound up, since the first of them leaves out the rest.
    ranked = loudest.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "start"))), lambda r: r["start"]).alias("c"), F.max("peak_value").alias("top"))
    found = sizes.join(ranked, file, "left")
    middle = F.array(F.greatest(F.lit(0), F.floor(F.col("n") / 2).cast("int") - size // 2))
    return found.select(file, F.when(F.col("n") <= size, F.array(F.lit(0))).when(F.coalesce("top", F.lit(0.0)) < salience.SILENCE, middle).otherwise(salience.apart(F.col("c"), size // 2, most)).alias("starts"))


def gain_controlled(
    segments: DataFrame, rate: int, hop: int, gain: float = 0.98, bias: float = 2.0, power: float = 0.5, seconds: float = 0.4, floor: float = 1e-6, scale: float = 2.0**31, file: str = "file", column: str = "frames"
) -> DataFrame:
    """Segments (file, segment, an array of frames of bins) with gain control per bin, as of the whole spectrogram.

    A segment moves the filter's state m to d m + o: d a power of one number, o what the segment alone leaves. These steps,
    a row a segment, are composed along each file, and each segment is then filtered from its own start."""
    b = smoothing(seconds, rate, hop)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, counts = [], []
            for frames in batch.column(2).to_pylist():
                s = np.asarray(frames, np.float64) * scale
                fade = (1 - b) ** np.arange(len(s) - 1, -1, -1)
                left.append((b * (fade[:, None] * s).sum(0)).tolist() if len(s) else [])
                counts.append(len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int32()), pa.array(left, pa.list_(pa.float64()))], [file, "segment", "n", "left"])

    kind = segments.schema[file].dataType.simpleString()
    steps = segments.select(file, F.col("segment").cast("int").alias("segment"), column).mapInArrow(step, f"`{file}` {kind}, segment int, n int, left array<double>").where("n > 0")

    def composed(acc: Column, x: Column) -> Column:
        decay = F.pow(F.lit(1 - b), x["n"])
        moved = F.zip_with(acc["m"], x["left"], lambda m, o: m * decay + o)
        return F.struct(moved.alias("m"), F.array_append(acc["out"], F.struct(x["segment"].alias("segment"), acc["m"].alias("m"))).alias("out"))

    ordered = steps.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("segment", "n", "left"))).alias("x"))  # a row a segment
    ones = F.transform(F.get("x", F.lit(0))["left"], lambda _: F.lit(1.0))
    start = F.struct(ones.alias("m"), F.array().cast("array<struct<segment:int,m:array<double>>>").alias("out"))
    states = ordered.select(file, F.explode(F.aggregate("x", start, composed, lambda acc: acc["out"])).alias("s")).select(F.col(file).alias("__f"), F.col("s.segment").alias("__s"), F.col("s.m").alias("__m"))
    both = segments.join(states, (F.col(file) == F.col("__f")) & (F.col("segment") == F.col("__s"))).select(file, "segment", column, "__m")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for frames, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, m = np.asarray(frames, np.float64) * scale, np.asarray(m)
                out = np.empty_like(s)
                for t in range(len(s)):
                    m = (1 - b) * m + b * s[t]
                    out[t] = bias**power * np.expm1(power * np.log1p(s[t] * np.exp(-gain * (np.log(floor) + np.log1p(m / floor))) / bias))
                done.append(out.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(done, pa.list_(pa.list_(pa.float64())))], [file, "segment", column])

    return both.withColumn("segment", F.col("segment").cast("int")).mapInArrow(filtered, f"`{file}` {kind}, segment int, `{column}` array<array<double>>")
