"""What the operators of this subpackage share: the shared folder, written intermediate tables, text arrays."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir


#: Rows of an Arrow batch: texts are long, and a batch with what is made of it must fit a worker's memory.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows. A setting of the session that stays: plans are lazy, and their batches are cut when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is frequent if it has more than this share of all rows: at most as many keys as fit into 1.
FREQUENT = 1 / 1_000


def joined(left: DataFrame, right: DataFrame, key: str, frequent: DataFrame, how: str = "inner") -> DataFrame:
    """`left` (inner or left) joined with `right`, which has a row a key. `frequent`: a written table of keys that have more than
    FREQUENT of the rows, so 1/FREQUENT of them at most; their rows meet `right` by broadcast, all others by shuffle."""
    hot, few = F.broadcast(frequent.select(key)), F.broadcast(right.join(F.broadcast(frequent.select(key)), key, "left_semi"))
    rest = left.join(hot, key, "left_anti").join(right.hint("merge"), key, how)
    return rest.unionByName(left.join(hot, key, "left_semi").join(few, key, how))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until `df` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def strings(column: pa.Array) -> list[str]:
    """Python strings of a string or binary array; null becomes the empty string, bad UTF-8 the replacement mark."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b.decode("utf-8", "replace") if b is not None else "" for b in column.cast(kind).to_pylist()]


def by_size(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to `most` at most; a larger item stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
