"""Report tables and texts from scored rows and metrics."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import bootstrap, ranking


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin, n for `bins` equal parts of 0 to 1; 1 is in the last, values outside in none."""
    held = rows.where(F.col(value).between(0, 1)).select(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(held.groupBy("bin").count(), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def bars(rows: DataFrame, value: str, width: int = 40) -> DataFrame:
    """`rows` (a bounded report) with `bar`: as many marks as its share of the largest value gives."""
    top = rows.agg(F.max(value).alias("__top"))
    return rows.join(F.broadcast(top)).withColumn("bar", F.repeat(F.lit("#"), F.coalesce(F.floor(F.try_divide(F.lit(width) * F.col(value), F.col("__top"))), F.lit(0)).cast("int"))).drop("__top")


def precision_bands(points: DataFrame, bands: int = 10) -> DataFrame:
    """band, recall: the best recall of points whose precision lies in the band, both edges included; 0 without any."""
    # A precision on an edge is in two bands.
    scaled = F.col("precision") * bands
    low, at = F.floor(scaled), F.round(scaled)
    edge = (F.col("precision") == at / bands) & (at > 0)
    own = points.select(F.explode(F.when(edge, F.array(at - 1, at)).otherwise(F.array(low.cast("double"))).cast("array<int>")).alias("band"), "recall")
    grid = points.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    return grid.join(own.groupBy("band").agg(F.max("recall").alias("recall")), "band", "left").select("band", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def det_bands(points: DataFrame, bands: int = 10) -> DataFrame:
    """band, far: the least false acceptance of points whose false rejection lies in [band, band + 1); 1 without any."""
    at = F.col("frr") * bands
    near = F.round(at)
    band = F.when(F.col("frr") == near / bands, near).otherwise(F.floor(at)).cast("int")
    grid = points.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    return grid.join(points.groupBy(band.alias("band")).agg(F.min("far").alias("far")), "band", "left").select("band", F.coalesce("far", F.lit(1.0)).alias("far"))


def latency(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """mean, median, p95, p99 (interpolated) and n per group."""
    by = list(by)
    sums = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    marks = ranking.percentiles(rows, value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, by)
    both = sums.join(marks.withColumnsRenamed({k: f"__{k}" for k in by}), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by)), "left") if by else sums.join(F.broadcast(marks))
    return both.select(*by, "mean", "median", "p95", "p99", "n")


def device_lines(scored: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """file, rank, class, percent in tenths, cut off; the k best classes down to the threshold."""
    return ranking.top_classes(scored, k).where(F.col("s") >= threshold).withColumn("percent", F.floor(F.col("s") * 1000) / 10)


def predictions(scored: DataFrame, classes: list, file: str = "file", cls: str = "class") -> DataFrame:
    """A row per file: its label, top class and score, and each class's score as text with three places."""
    text = F.format_string("%.3f", F.bround("s", 3))
    top = F.max_by(cls, F.struct("s", (-F.col(cls)).alias("first")))
    return scored.groupBy(file).agg(
        F.max(F.when(F.col("y") == 1, F.col(cls))).alias("label"), top.alias("top1_label"), F.format_string("%.3f", F.bround(F.max("s"), 3)).alias("top1_score"),
        *(F.max(F.when(F.col(cls) == c, text)).alias(f"c{c}") for c in classes),
    )


def species_report(scored: DataFrame, group: str, order: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """class, ap, ci_lower, ci_upper, n_positive, n_total with six places, best first; one kind of truth only: the interval is the point."""
    points = ranking.average_precision(scored, [group])
    found = points.join(bootstrap.intervals(scored, group, order, resamples, confidence), group, "left")
    six = lambda c: F.round(c, 6)
    return found.select(
        group, six(F.col("ap")).alias("ap"), six(F.coalesce("ci_lower", "ap")).alias("ci_lower"), six(F.coalesce("ci_upper", "ap")).alias("ci_upper"), "n_positive", "n_total"
    ).orderBy(F.desc("ap"), group)


def benchmark_json(scored: DataFrame, classes: int, model: str = "", species: DataFrame | None = None, config: str | None = None) -> DataFrame:
    """One row of JSON: the model's path, the number of classes and files, the overall metrics with six places, and where they are
    given the species report and the model's settings (JSON text)."""
    all_of = ranking.micro_scores(scored).join(F.broadcast(ranking.roc_auc(scored))).join(F.broadcast(ranking.average_precision(scored).select(F.col("ap").alias("map"))))
    names = {"f1": "f1", "map": "map", "precision": "precision", "recall": "recall", "roc_auc": "auc"}
    inner = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.format_string("%.6f", F.col(c))) for n, c in names.items()))
    head = F.to_json(F.struct(F.lit(model).alias("model_path"), F.lit(classes).alias("num_classes"), F.col("files").alias("num_files")))
    parts = [F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"metrics":{'), inner, F.lit("}")]
    rows = all_of.join(F.broadcast(scored.agg(F.countDistinct("file").alias("files")))).withColumn("head", head)
    if species is not None:  # a row per class
        one = F.concat(F.lit('{"class":'), F.to_json(F.struct(F.col("class").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("class").alias("v")))) - 6), *(F.concat(F.lit(f',"{n}":'), F.format_string("%.6f", n)) for n in ("ap", "ci_lower", "ci_upper")), *(F.concat(F.lit(f',"{n}":'), F.col(n).cast("string")) for n in ("n_positive", "n_total")), F.lit("}"))
        listed = species.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ap")).alias("o"), "class", one.alias("j")))), lambda x: x["j"]), ",").alias("species"))
        rows = rows.join(F.broadcast(listed))
        parts += [F.lit(',"species":['), F.col("species"), F.lit("]")]
    if config is not None:
        parts.append(F.lit(',"config":' + config))
    return rows.select(F.concat(*parts, F.lit("}")).alias("json"))


def html_report(title: str, tables: dict[str, DataFrame], drawings: dict[str, DataFrame] | None = None) -> str:
    """A page with a table per report, all its rows (give it reports, which have a row per class or less), and drawings, frames of one
    row with a column svg."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.6f}' if isinstance(v, float) else str(v))}</td>" for v in row) + "</tr>" for row in df.toLocalIterator())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    for name, df in (drawings or {}).items():
        out.append(f"<h2>{html.escape(name)}</h2><div>{df.first()['svg']}</div>")
    return "".join([*out, "</body></html>"])
