"""The driver's tables as scored recordings, and the same in SQL.

Scores come from stored floats by exact steps (halving, powers of two), so both engines have equal
numbers before anything is summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import table

CLASSES = 10

# Rows (file, class, y, s): a class's score is an element of the vector, in 1/256.
SCORED = """scored AS (
    SELECT vec_id AS file, c.class, CASE WHEN label = c.class THEN 1 ELSE 0 END AS y,
           floor((embedding[c.class + 1]::DOUBLE + 1) * 128) / 256 AS s
    FROM embeddings CROSS JOIN (SELECT unnest(range(0, 10))::INT AS class) c
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file"), "label", F.posexplode(F.slice("embedding", 1, CLASSES)).alias("class", "x"))
    return rows.select("file", "class", (F.col("label") == F.col("class")).cast("int").alias("y"), (F.floor((F.col("x").cast("double") + 1) * 128) / 256).alias("s"))


# Rows (file, chunk_idx, class, score): four vectors are a file's chunks.
CHUNKED = """chunked AS (
    SELECT vec_id // 4 AS file, (vec_id % 4)::INT AS chunk_idx, c.class, floor((embedding[c.class + 1]::DOUBLE + 1) * 128) / 256 AS score
    FROM embeddings CROSS JOIN (SELECT unnest(range(0, 10))::INT AS class) c
)"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, CLASSES)).alias("class", "x"))
    return rows.select(
        F.floor(F.col("vec_id") / 4).alias("file"), (F.col("vec_id") % 4).cast("int").alias("chunk_idx"), "class", (F.floor((F.col("x").cast("double") + 1) * 128) / 256).alias("score")
    )


# A large fact: rows of lineitem as scored by quantity and discount, in classes by supplier.
LARGE = """large AS (
    SELECT (l_suppkey % 50)::INT AS class, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, floor(l_extendedprice / 64) / 2048 AS s FROM lineitem
)"""


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).cast("int").alias("class"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.floor(F.col("l_extendedprice") / 64) / 2048).alias("s")
    )
