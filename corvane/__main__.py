"""Reports from the command line, through whatever session spark-submit gives.

    python -m corvane report --scores PARQUET --out FOLDER [--pooling average|max|lme] [--threshold 0.5] [--bootstrap 1000]
    python -m corvane board --log FILE --out FOLDER [--top-k 5] [--threshold 0.01] [--chunk-seconds 3]

Scores are rows (file, label, class, score), one per chunk or per file; classes and labels are integers.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation, pooling, ranking, reports, telemetry
from corvane.sources import texts


def report(spark: SparkSession, scores: DataFrame, out: str, method: str = "average", threshold: float = 0.5, resamples: int = 1000) -> dict[str, DataFrame]:
    """Writes the reports of an evaluation as CSV folders and a page; returns their frames."""
    pooled = pooling.pool(scores, ["file", "label", "class"], method).withColumnRenamed("score", "s")
    scored = evaluation.truth(pooled, F.col("label")).select("file", "class", "y", "s").cache()
    classes = [r["class"] for r in scored.select("class").distinct().orderBy("class").collect()]  # as many as the model has
    tables = {k: v for k, v in evaluation.evaluate(scored).items() if k in ("micro", "roc_auc", "map", "cmap", "thresholds", "det")}
    tables |= {"species": reports.species_report(scored, "class", "file", resamples), "confusion": ranking.confusion(scored, threshold), "histogram": reports.bars(reports.histogram(scored, "s"), "n"), "predictions": reports.predictions(scored, classes)}
    for name, df in tables.items():  # what grows with the files stays in parts, reports are one file in their order
        texts.save_csv(df if name in ("predictions", "det") else df.coalesce(1), f"{out}/{name}")
    texts.save_lines(reports.benchmark_json(scored, len(classes)), "json", f"{out}/benchmark")
    page = reports.html_report("Evaluation", {k: tables[k] for k in ("micro", "roc_auc", "map", "cmap", "species", "confusion")})
    texts.save_lines(spark.createDataFrame([(page,)], "page string"), "page", f"{out}/page")
    scored.unpersist()
    return tables


def board(spark: SparkSession, log: str, out: str, k: int = 5, threshold: float = 0.01, chunk_seconds: float = 3.0) -> dict[str, DataFrame]:
    """Writes a device log's detections, timings and totals. A log is one file, read in splits: a line's number is where its split
    begins plus its place there, which keeps the order."""
    read = spark.read.text(log).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    firsts = read.groupBy("block").agg(F.min("id").alias("first"))
    lines = read.join(firsts, "block").select(F.lit("board").alias("device"), (F.col("block") + F.col("id") - F.col("first")).alias("line_no"), "line")
    tables = {
        "detections": telemetry.detections(lines, threshold, k),
        "board": telemetry.board_rows(telemetry.results(lines, threshold, k)),
        "timings": telemetry.timings(lines),
        "totals": telemetry.real_time(telemetry.totals(lines), chunk_seconds=chunk_seconds),
    }
    for name, df in tables.items():
        texts.save_csv(df, f"{out}/{name}")
    return tables


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report")
    one.add_argument("--scores", required=True)
    one.add_argument("--out", required=True)
    one.add_argument("--pooling", default="average")
    one.add_argument("--threshold", type=float, default=0.5)
    one.add_argument("--bootstrap", type=int, default=1000)
    two = commands.add_parser("board")
    two.add_argument("--log", required=True)
    two.add_argument("--out", required=True)
    two.add_argument("--top-k", type=int, default=5)
    two.add_argument("--threshold", type=float, default=0.01)
    two.add_argument("--chunk-seconds", type=float, default=3.0)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    if given.command == "report":
        report(spark, spark.read.parquet(given.scores), given.out, given.pooling, given.threshold, given.bootstrap)
    else:
        board(spark, given.log, given.out, given.top_k, given.threshold, given.chunk_seconds)


if __name__ == "__main__":
    main()
