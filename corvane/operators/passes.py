"""Passes over samples in a new order each, without a sort of all: places from a keyed permutation, shards by row count.

A row's number is permuted by a small Feistel network on two halves, keyed by the pass: any row's slot, and any
slot's row, is known by arithmetic alone. Slots are cut into shards of about SHARD_ROWS; a task has one shard,
orders it and gives its rows through a bounded buffer, in blocks of Arrow columns. A lost task is run again to
the same rows in the same order; a pass over more rows has more tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS, ROUNDS = 2_147_483_647, 4
SHARD_ROWS = 100_000


def sides(n: int) -> tuple[int, int]:
    """Two numbers of about the root of n whose product is n or a little more: the slots of a pass."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mixed(x, key: int):
    """A number below MODULUS from a half and a round's key; the square parts neighbours."""
    d = ((x + 1) * 1103515245 + key * 12345) % MODULUS
    return (d * d + key) % MODULUS * 48271 % MODULUS


def slot_of(number: Column, n: int, turn: int, seed: int = 42) -> Column:
    """The slot of row `number` (from 0) of n in pass `turn`: different for each row, below the product of `sides`."""
    a, b = sides(n)
    left, right = F.floor(number / b).cast("long"), (number % b).cast("long")
    for i in range(ROUNDS):
        key = seed + ROUNDS * turn + i
        if i % 2 == 0:
            left = (left + _mixed(right, key)) % a
        else:
            right = (right + _mixed(left, key)) % b
    return left * b + right


def row_at(slot: int, n: int, turn: int, seed: int = 42) -> int | None:
    """The number of the row in a slot; none in one of the few slots beyond n rows."""
    a, b = sides(n)
    left, right = divmod(slot, b)
    for i in reversed(range(ROUNDS)):
        key = seed + ROUNDS * turn + i
        if i % 2 == 0:
            left = (left - _mixed(right, key)) % a
        else:
            right = (right - _mixed(left, key)) % b
    number = left * b + right
    return number if number < n else None


def file_numbers(rows: DataFrame, column: str = "number") -> DataFrame:
    """`rows`, read from Parquet files, with numbers from 0 on: by file, then by place in the file. Files are counted, no row moves."""
    from pyspark.sql.window import Window

    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
    starts = placed.groupBy("__file").agg((F.max("__row") + 1).alias("__n")).select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, "__file").withColumn(column, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start")


def dealt(rows: DataFrame, n: int, turn: int, number: str = "number", shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """`rows`, numbered from 0 to n - 1, with shard and slot of a pass."""
    a, b = sides(n)
    size = -(-a * b // max(1, -(-n // shard_rows)))
    slots = rows.withColumn("slot", slot_of(F.col(number), n, turn, seed))
    return slots.withColumn("shard", F.floor(F.col("slot") / size).cast("int"))


def through_buffer(batches: Iterator[pa.RecordBatch], high: int, low: int, draw: np.random.Generator) -> Iterator[pa.Table]:
    """Rows through a buffer: at `high` held they are shuffled and given until `low` are left; at the end all are."""
    held: pa.Table | None = None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, high - (0 if held is None else held.num_rows))
            at += part.num_rows
            held = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
            if held.num_rows >= high:
                order = draw.permutation(held.num_rows)
                yield held.take(pa.array(order[low:]))
                held = held.take(pa.array(order[:low]))
    if held is not None and held.num_rows:
        yield held.take(pa.array(draw.permutation(held.num_rows)))


def in_order(rows: DataFrame, n: int, turn: int, high: int, low: int, number: str = "number", shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """`rows` as a pass gives them, with shard, slot and place in the shard's order; a task a shard."""
    if not 0 <= low < high:
        raise ValueError("the buffer is drained to less than it is filled to")
    shards = max(1, -(-n // shard_rows))
    laid = dealt(rows, n, turn, number, shard_rows, seed)
    ordered = laid.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = iter(batches)
        first = next(waiting, None)
        while first is not None and not first.num_rows:
            first = next(waiting, None)
        if first is None:
            return
        draw = np.random.default_rng([seed, turn, first.column("shard")[0].as_py()])

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from waiting

        place = 0
        for block in through_buffer(all_of(), high, low, draw):
            out = block.append_column("place", pa.array(np.arange(place, place + block.num_rows)))
            place += block.num_rows
            yield from out.combine_chunks().to_batches()

    return ordered.mapInArrow(give, T.StructType([*laid.schema.fields, T.StructField("place", T.LongType())]))
