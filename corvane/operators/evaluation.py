"""The paths from recordings to samples and from recordings to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import arrays
from corvane.functions.frontends import Feature, features, flat
from corvane.operators import augment, catalog, pooling, ranking, salience, scoring


def chunk_limit(most: int) -> int:
    """Candidates looked at for `most` chunks of a file."""
    return min(8, max(4, 2 * most))


def candidate_chunks(signals: DataFrame, classes: DataFrame, size: int, most: int, file: str = "file") -> DataFrame:
    """file, class_idx (null for noise), chunk_idx, start, samples: the chunks of each signal (file, label, samples) that are rated.

    Unknown labels go before anything else is done. Long signals are cut around their loudest regions, others into all
    their chunks. A signal without samples (or null: not decoded) becomes a chunk of uniform noise drawn from its file,
    without a class.
    """
    named = classes.select(F.col("class").alias("__c"), "class_idx")
    known = signals.join(named, F.col("label") == F.col("__c"), "left").where(F.col("class_idx").isNotNull() | catalog.is_noise(F.col("label")))
    x, limit = arrays.doubles(F.col("samples")), chunk_limit(most)
    starts = F.when(arrays.n_chunks(F.size("samples"), size, size) > limit, salience.crops(x, size, limit)).otherwise(arrays.chunk_starts(F.size("samples"), size, size))
    silent = F.coalesce(F.size("samples"), F.lit(0)) <= 0
    noise = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: 2 * augment.uniform(F.col(file), "noise", i) - 1)
    heard = known.withColumns({"samples": F.when(silent, noise).otherwise(x), "class_idx": F.when(~silent, F.col("class_idx"))})
    cut = heard.select(file, "class_idx", F.col("samples").alias("__x"), F.posexplode(starts).alias("chunk_idx", "start"))
    own = arrays.fitted(F.slice(arrays.doubles(F.col("__x")), F.col("start") + 1, F.lit(size)), size)
    return cut.select(file, "class_idx", "chunk_idx", "start", own.alias("samples"))


def training_samples(signals: DataFrame, classes: DataFrame, size: int, most: int = 1, threshold: float = 0.1, width: int | None = None, file: str = "file") -> DataFrame:
    """file, chunk_idx, start, class_idx (null for noise), samples: the most active chunks of each signal (file, label, samples), as
    the raw frontend takes them. Each file keeps its best chunk and up to `most` above the threshold."""
    rated = candidate_chunks(signals, classes, size, most, file).withColumn("activity", salience.activity_ratio(F.col("samples")))
    kept = salience.ranked_chunks(rated, "activity", threshold, most, file)
    return kept.select(file, "chunk_idx", "start", "class_idx", (arrays.model_input(F.col("samples"), width or size)).alias("samples"))


def training_features(
    signals: DataFrame, classes: DataFrame, feature: Feature, size: int, most: int = 1, threshold: float = 0.1, masks: tuple[int, int, int] | None = None, seed: int = 42, file: str = "file"
) -> DataFrame:
    """file, chunk_idx, start, class_idx (null for noise), feature: the chunks of each signal whose features are most active.

    Chunks are cut as for `training_samples`; each becomes the frontend's feature, whose activity decides. `masks` (rows at
    most, frames at most, how many of each) zeroes seeded stretches of the kept features of all frontends but the raw one.
    """
    made = candidate_chunks(signals, classes, size, most, file).withColumn("feature", features(feature)(F.col("samples"))).drop("samples")
    rated = made.withColumn("activity", salience.activity_ratio(flat(F.col("feature"))))
    kept = salience.ranked_chunks(rated, "activity", threshold, most, file)
    rows, frames = feature.shape(size)
    out = F.col("feature")
    if feature.frontend == "raw":
        out = F.transform(out, lambda r: arrays.model_input(r, size))
    elif masks:
        widest_rows, widest_frames, n = masks
        key = F.pmod(F.xxhash64(F.col(file).cast("string"), "chunk_idx"), F.lit(1_000_003))
        out = augment.masked_spectrum(out, augment.seeded_masks(key, rows, widest_rows, n, seed), "freq")
        out = augment.masked_spectrum(out, augment.seeded_masks(key, frames, widest_frames, n, seed + 2), "time")
    return kept.select(file, "chunk_idx", "start", "class_idx", out.alias("feature"))


def calibration_samples(chunks: DataFrame, threshold: float = 0.01, n: int = 100, samples: str = "samples", key: str = "file") -> DataFrame:
    """The middle chunk of each file that is not near silence, `n` files in a seeded order."""
    middle = chunks.groupBy(key).agg(arrays.centre(F.array_sort(F.collect_list(F.struct("chunk_idx", samples)))).alias("m")).select(key, F.col(f"m.{samples}").alias(samples))
    heard = middle if threshold <= 0 else middle.where(arrays.rms(arrays.doubles(F.col(samples))) >= threshold)
    return heard.orderBy(catalog.order_key(F.col(key)), key).limit(n)


def file_scores(
    signals: DataFrame, model: str, size: int, classes: int, method: str = "average", step: int | None = None, batch: int = 64, width: int | None = None, feature: Feature | None = None
) -> DataFrame:
    """file, label, class, s: scores of all chunks of each signal (file, label, samples), pooled; files without samples are left out.

    Without `feature` the model takes a chunk's samples as they are; else the frontend's feature, its rows one after the other."""
    cut = signals.where(F.size("samples") > 0).select("file", "label", F.posexplode(arrays.chunks(arrays.doubles(F.col("samples")), size, step or size)).alias("chunk_idx", "c"))
    x, taken = F.col("c.samples"), width or size
    if feature is not None and feature.frontend == "raw":
        x = arrays.model_input(x, taken)
    elif feature is not None:
        rows, frames = feature.shape(size)
        x, taken = flat(features(feature)(x)), rows * frames
    scored = scoring.scored(cut.select("file", "label", "chunk_idx", x.alias("x")), model, "x", taken, batch=batch)
    long = scored.select("file", "label", F.posexplode("scores").alias("class", "score")).where(F.col("class") < classes)
    return pooling.pool(long, ["file", "label", "class"], method).withColumnRenamed("score", "s")


def truth(scores: DataFrame, label: Column) -> DataFrame:
    """`scores` with y: whether the class is the file's."""
    return scores.withColumn("y", (F.col("class") == label).cast("int"))


def evaluate(scored: DataFrame) -> dict[str, DataFrame]:
    """The reports of an evaluation over rows (file, class, y, s), each a frame of its own: nothing runs before one is asked for."""
    per_class = ranking.average_precision(scored, ["class"])
    return {
        "micro": ranking.micro_scores(scored), "roc_auc": ranking.roc_auc(scored), "map": ranking.average_precision(scored), "classes": per_class, "cmap": ranking.mean_average_precision(per_class),
        "thresholds": ranking.best_thresholds(scored, ["class"]), "det": ranking.det_curve(scored), "precision_recall": ranking.precision_recall_points(scored), "confusion": ranking.confusion(scored), "top": ranking.top_classes(scored),
    }
