"""Bootstrap intervals against plain sums over all rows and resamples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import bootstrap, ranking


def plain(rows, resamples, confidence=0.95):
    """rows (group, y, s, row) to group: (lower, upper)."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        points = []
        for b in range(resamples):
            sums = {}
            for _, y, s, row in own:
                d = ((row % bootstrap.MODULUS + 1) * 1103515245 + (b + 1) * 12345) % bootstrap.MODULUS
                for add in ((b + 1) * 69621, row % bootstrap.MODULUS + 1, (b + 1) * 40503):
                    d = (d * d + add) % bootstrap.MODULUS
                w = sum(d >= x for x in bootstrap.WEIGHTS)
                t, n = sums.get(s, (0, 0))
                sums[s] = (t + w * y, n + w)
            p, q = sum(t for t, _ in sums.values()), sum(n for _, n in sums.values())
            if not 0 < p < q:
                continue
            ctp = cn = ap = 0
            for s in sorted(sums, reverse=True):
                t, n = sums[s]
                ctp, cn = ctp + t, cn + n
                ap += t / p * ctp / cn if n else 0
            points.append(ap)
        if points:
            out[g] = tuple(np.percentile(points, [50 * (1 - confidence), 100 - 50 * (1 - confidence)]))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(6)
    out = []
    for i in range(900):
        g = int(draw.integers(3))
        s = 0.5 if draw.random() < 0.35 else round(float(draw.random()), 2)
        out.append((g, int(draw.random() < (0.3 if g else 0.02)), s, i * 7))
    return out + [(5, 1, 0.5, 1), (5, 1, 0.6, 2), (6, 0, 0.1, 3)]


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("numbers", [2_000_000, 60])
def test_intervals(spark, rows, ranges, numbers, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_BYTES", 1 << 62 if ranges == 1 else 0)
    monkeypatch.setattr(ranking, "RANGES", 5)
    monkeypatch.setattr(bootstrap, "BATCH_NUMBERS", numbers)
    df = spark.createDataFrame(rows, "g int, y int, s double, id long").repartition(3)
    monkeypatch.setattr(ranking, "n_ranges", lambda _: ranges)
    found = {r["g"]: (r["ci_lower"], r["ci_upper"]) for r in bootstrap.intervals(df, "g", "id", 30).collect()}
    wanted = plain(rows, 30)
    assert found.keys() == wanted.keys() == {0, 1, 2}
    assert all(math.isclose(a, b, abs_tol=1e-9) for g in wanted for a, b in zip(found[g], wanted[g]))


def test_weights_are_the_draws(spark):
    ids = np.array([0, 1, 5, 123_456_789_012, 2**40])
    got = spark.createDataFrame([(int(i), b) for i in ids for b in range(9)], "id long, b long")
    drawn = bootstrap.with_draws(got, F.col("id"), F.col("b")).collect()
    wanted = {(r["id"], r["b"]): sum(r["__draw"] >= w for w in bootstrap.WEIGHTS) for r in drawn}
    found = bootstrap.weights(ids, 9)
    assert all(found[i, b] == wanted[int(x), b] for i, x in enumerate(ids) for b in range(9))
    assert abs(bootstrap.weights(np.arange(2000), 50).mean() - 1) < 0.02


def test_rows_of_one_score_are_merged_where_they_are_read(spark, rows):
    df = spark.createDataFrame(rows, "g int, y int, s double, id long").select("g", F.col("y").cast("long").alias("y"), "s", F.col("id").alias("row")).coalesce(1)
    laid = bootstrap.merged_ties(df, ["g"], 30).collect()
    whole = [r for r in laid if r["tp"] is not None]
    assert len(laid) < 0.75 * len(rows) and {r["s"] for r in whole} == {0.5}
    for r in whole:
        w = bootstrap.weights(np.array([x[3] for x in rows if x[0] == r["g"] and x[2] == 0.5]), 30)
        assert r["n"] == w.sum(0).tolist()


def test_no_row_is_multiplied_by_resamples(spark, rows):
    df = spark.createDataFrame(rows, "g int, y int, s double, id long")
    plan = bootstrap.intervals(df, "g", "id", 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 2 + 1 and "explode(sequence" not in plan
