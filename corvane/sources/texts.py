"""Text lists, JSON settings and report files, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.augment import uniform
from corvane.operators.catalog import order_key, species_list


def load_species(spark: SparkSession, path: str) -> DataFrame:
    """A list's names in their order: line_no, species; blank lines are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "species"))
    return lines.select("line_no", F.trim("species").alias("species")).where(F.length("species") > 0)


def open_species(spark: SparkSession, path: str) -> DataFrame:
    """A list's names once each, sorted; an empty list is an error."""
    found = species_list(spark.read.text(path))
    if found.isEmpty():
        raise ValueError(f"no species in {path}")
    return found


def save_lines(rows: DataFrame, column: str, path: str) -> None:
    """One value a line in one file: lists are small."""
    rows.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_csv(rows: DataFrame, path: str, separator: str = ",", append: bool = False) -> None:
    """A report with a header."""
    rows.write.mode("append" if append else "overwrite").option("header", True).option("sep", separator).csv(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """A training history: epoch and metrics by name."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


#: Divides documents of several lines in one file.
DOCUMENT_END = "\n\f\n"


def load_config(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """JSON documents as rows of text, for config.parsed: a file each, or divided by `end`."""
    return spark.read.text(path, lineSep=end) if end else spark.read.text(path, wholetext=True)


def random_calibration(spark: SparkSession, n: int, width: int, normal: bool = False, seed: int = 42) -> DataFrame:
    """Rows (id, values) to calibrate with where there are no recordings: uniform, or normal."""
    draw = F.randn if normal else F.rand
    return spark.range(n).select("id", F.array(*(draw(seed + i) for i in range(width))).alias("values"))


def noise_rows(rows: DataFrame, key: str, width: int, seed: int = 42) -> DataFrame:
    """`rows` with values: `width` uniform numbers a row, from digests of its key, so that they can be drawn again anywhere."""
    return rows.withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: uniform(F.col(key), "calibration", i, seed=seed)))


def validation_sample(rows: DataFrame, key: str, n: int = 25, seed: int = 42) -> DataFrame:
    """`n` rows in a seeded order of their keys."""
    return rows.orderBy(order_key(F.col(key), seed), key).limit(n)
