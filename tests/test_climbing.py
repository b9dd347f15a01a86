"""Series that are folded row by row against the fold over arrays."""

import numpy as np
from pyspark.sql import functions as F

from corvane.streaming import device


def test_rows_give_what_arrays_give(spark):
    draw = np.random.default_rng(2)
    rows = [(k, i, float(round(draw.random() * 100, 1)), float(draw.choice([0, 3, 9, 16]))) for k in (1, 2, None, 7) for i in range(int(draw.integers(1, 60)))]
    df = spark.createDataFrame(rows, "k long, i int, throughput double, memory_free double").repartition(5)
    found = {r[0]: r[1] for r in device.climbed(df, "k", ["i"]).collect()}
    arrays = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "throughput", "memory_free"))).alias("s"))
    wanted = {r[0]: r[1] for r in arrays.select("k", device.backpressure(F.col("s"))).collect()}
    assert found == wanted and len(set(wanted.values())) > 1
    assert device.climbed(df.limit(0), "k", ["i"]).collect() == []
