"""Passes: permutations with random access, the same again, through a bounded buffer."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import passes


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_a_pass_is_a_permutation_with_random_access(spark, n):
    a, b = passes.sides(n)
    assert n <= a * b < n + a
    orders = []
    for turn in (0, 1, 7):
        slots = {r[0]: r[1] for r in spark.range(n).select("id", passes.slot_of(F.col("id"), n, turn)).collect()}
        assert len(set(slots.values())) == n and all(0 <= s < a * b for s in slots.values())
        assert all(passes.row_at(s, n, turn) == i for i, s in slots.items())
        assert sum(passes.row_at(s, n, turn) is None for s in range(a * b)) == a * b - n
        orders.append(tuple(sorted(slots, key=slots.get)))
    if n > 90:
        assert len(set(orders)) == 3
        moved = np.array(orders[0])
        assert abs(np.corrcoef(moved, np.arange(n))[0, 1]) < 0.35 and np.mean(np.abs(np.diff(moved)) == 1) < 0.1


def test_rows_pass_the_buffer(spark):
    n = 2_500
    rows = spark.range(n).select(F.col("id").alias("number"), F.concat(F.lit("x"), "id").alias("x")).repartition(5)
    found = passes.in_order(rows, n, 3, 64, 20, shard_rows=600)
    first, again = found.collect(), passes.in_order(rows.repartition(2), n, 3, 64, 20, shard_rows=600).collect()
    key = lambda r: (r["shard"], r["place"])
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and found.rdd.getNumPartitions() == 5
    assert sorted(r["number"] for r in first) == list(range(n)) and all(r["x"] == f"x{r['number']}" for r in first)
    sizes = []
    for shard in range(5):
        own = sorted((r for r in first if r["shard"] == shard), key=key)
        assert [r["place"] for r in own] == list(range(len(own)))
        rank = {s: i for i, s in enumerate(sorted(r["slot"] for r in own))}
        assert all(rank[r["slot"]] < r["place"] + 64 for r in own)  # no row is given before it can have been read
        sizes.append(len(own))
    assert max(sizes) - min(sizes) < 60
    other = passes.in_order(rows, n, 4, 64, 20, shard_rows=600).collect()
    assert [r["number"] for r in sorted(other, key=key)] != [r["number"] for r in sorted(first, key=key)]


def test_the_buffer_is_bounded():
    batches = [pa.record_batch({"i": np.arange(a, a + n)}) for a, n in ((0, 5), (5, 300), (305, 1), (306, 0), (306, 44))]
    blocks = [b["i"].to_pylist() for b in passes.through_buffer(iter(batches), 50, 10, np.random.default_rng(1))]
    assert sorted(x for b in blocks for x in b) == list(range(350)) and max(map(len, blocks)) <= 50
    given = 0
    for b in blocks:
        given += len(b)
        assert max(b) < given + 50
    assert list(passes.through_buffer(iter([]), 50, 10, np.random.default_rng(1))) == []


def test_numbers_of_files(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    found = passes.file_numbers(rows).collect()
    assert sorted(r["number"] for r in found) == list(range(1000)) and sorted(r["id"] for r in found) == list(range(1000))
    assert {r["id"]: r["number"] for r in found} == {r["id"]: r["number"] for r in passes.file_numbers(spark.read.parquet(str(tmp_path / "t"))).collect()}


def test_no_rows_and_bad_marks(spark):
    assert passes.in_order(spark.range(0).withColumnRenamed("id", "number"), 0, 0, 8, 2).count() == 0
    with pytest.raises(ValueError):
        passes.in_order(spark.range(3).withColumnRenamed("id", "number"), 3, 0, 8, 8)
