"""Endless passes over samples in the order of a bounded buffer: filled to a mark, shuffled, drained to a lower one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.augment import uniform


def drained(high: int, low: int, draw: np.random.Generator, items: Iterator) -> Iterator:
    """`items` through the buffer: at `high` held it is shuffled and drained to `low`; what is left at the end is shuffled too."""
    held = []
    for item in items:
        held.append(item)
        if len(held) >= high:
            draw.shuffle(held)
            while len(held) > low:
                yield held.pop()
    draw.shuffle(held)
    while held:
        yield held.pop()


def epoch(samples: DataFrame, number: int, high: int, low: int, shards: int = 8, key: str = "id", seed: int = 42) -> DataFrame:
    """`samples` with shard and place: the order in which each of `shards` loaders gives its share in pass `number`.

    Rows are dealt to loaders and put in a first order by digests of the key, so a pass can be repeated on any
    cluster; a loader holds `high` rows at most.
    """
    tag = str(number)
    dealt = samples.select("*", F.floor(uniform(F.col(key), "shard", tag, seed=seed) * shards).cast("int").alias("shard"))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", uniform(F.col(key), "order", tag, seed=seed), key)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns: list[str] = []

        def rows() -> Iterator[tuple]:
            for frame in frames:
                columns[:] = list(frame.columns)
                yield from frame.itertuples(index=False, name=None)

        def runs() -> Iterator[tuple]:
            waiting = rows()
            row = next(waiting, None)
            while row is not None:
                shard = row[-1]

                def own() -> Iterator[tuple]:
                    nonlocal row
                    while row is not None and row[-1] == shard:
                        yield row
                        row = next(waiting, None)

                for place, given in enumerate(drained(high, low, np.random.default_rng([seed, number, shard]), own())):
                    yield (*given, place)

        out: list[tuple] = []
        for row in runs():
            out.append(row)
            if len(out) >= high:
                yield pd.DataFrame(out, columns=[*columns, "place"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*columns, "place"])

    return ordered.mapInPandas(load, T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())]))


def epochs(samples: DataFrame, high: int, low: int, shards: int = 8, key: str = "id", seed: int = 42) -> Iterator[DataFrame]:
    """Pass after pass, without end; each is worked out when it is used."""
    number = 0
    while True:
        yield epoch(samples, number, high, low, shards, key, seed)
        number += 1
