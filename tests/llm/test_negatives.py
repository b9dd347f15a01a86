"""Hard negatives against plain loops over Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import negatives, queries, scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """Rows (id, vector, label) that take part to rows of the result."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in good if i % 50 == 0}:
        own = sorted(((-dot(v, w), j) for j, w, d in good if d == c and j != i))[:positives]
        other = sorted((-dot(v, w), j) for j, w, d in good if d != c)
        for s, j in own:
            found = [(n, t) for t, n in other if -low * s <= -100 * t <= -high * s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (n, t) in enumerate(found)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 50 == 0, F.col("label"), **more).collect()))


def vectors(n, seed, width=6, labels=4):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(0, 1, width).tolist(), int(draw.integers(labels))) for i in range(n)]


def test_hard_cases_of_the_tables(spark, tables):
    rows = [(r["vec_id"], r["embedding"], r["label"] if r["vec_id"] is None or r["label"] is None or r["vec_id"] % 7 else (r["label"] + 1) % 10) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    result = queries.op12_hard_negatives(spark, tables).collect()
    assert sorted(map(tuple, result)) == plain(rows) and len(result) > 20


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors_in_small_blocks(spark, seed, monkeypatch):
    rows = vectors(400, seed)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(60)]  # copies tie
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 150)
    monkeypatch.setattr(negatives, "BATCH_NUMBERS", 40)
    result = found(spark, rows)
    assert result == plain(rows) and len(result) > 30


def test_other_numbers_of_positives_and_windows(spark):
    rows = vectors(300, 9)
    assert found(spark, rows, positives=2, negatives=7, window=(10, 100)) == plain(rows, 2, 7, 10, 100)


def test_large_components_are_ranked_whole(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(0, 1, 3) * 1e6).tolist(), i % 3) for i in range(150)]
    assert scores.space(scores.integer_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")).wide
    result = found(spark, rows)
    assert result == plain(rows) and len(result) > 10
    beyond = [(i, (draw.normal(0, 1, 3) * 1e10).tolist(), i % 2) for i in range(120)]  # scores beyond 64 bits
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert found(spark, beyond) == sorted((*r[:4], held(r[4]), held(r[5])) for r in plain(beyond))


def test_without_anchors_or_partners(spark):
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert found(spark, [(50, [1.0], 0)]) == []
    assert found(spark, [(50, [1.0], 0), (1, [2.0], 0), (2, [1.0], 1), (3, [1.9], 1), (4, [0.9], 1)]) == plain([(50, [1.0], 0), (1, [2.0], 0), (2, [1.0], 1), (3, [1.9], 1), (4, [0.9], 1)])


def test_arrays_merge_in_any_order():
    draw = np.random.default_rng(1)
    score = draw.integers(0, 9, (5, 40)).astype(float)
    ids, counts = np.arange(40), draw.random((5, 40)) < 0.7
    whole = scores.best_columns(score, counts, ids, 4)
    for cut in (0, 3, 20, 40):
        parts = [scores.best_columns(score[:, a:b], counts[:, a:b], ids[a:b], 4) for a, b in ((cut, 40), (0, cut))]
        for x, y in zip(scores.merged(*parts, 4), whole):
            assert (x == y).all()
