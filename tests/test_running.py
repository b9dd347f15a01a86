"""Running sums, percentiles and places: windows and ranges give the same, and nothing runs while they are planned."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation, ranking
from corvane.operators.numbering import numbered


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    draw = np.random.default_rng(2)
    s = np.round(draw.random(4000), 2)
    s[draw.random(4000) < 0.3] = 0.25  # a third of all rows have one score
    rows = [(i, int(draw.integers(3)), int(draw.random() < 0.2), float(x)) for i, x in enumerate(s)]
    rows += [(9001, 1, 1, math.nan), (9002, 1, 0, math.inf), (9003, 1, 0, -math.inf), (9004, 2, 1, None), (9005, None, 1, 0.5)]
    folder = str(tmp_path_factory.mktemp("scored"))
    spark.createDataFrame(rows, "file long, class int, y int, s double").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def in_ranges(monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_BYTES", 0)
    monkeypatch.setattr(ranking, "RANGES", 7)


REPORTS = {
    "running": lambda df: ranking.running(ranking.tie_groups(df, ["class"]), ["class"]),
    "all": lambda df: ranking.running(ranking.tie_groups(df, []), []),
    "precision": lambda df: ranking.average_precision(df.where("s is not null"), ["class"]),
    "percentiles": lambda df: ranking.percentiles(df, "s", {"a": 0.5, "b": 0.95}, ["class"]),
    "numbered": lambda df: numbered(df, ["class"], [F.col("s"), F.col("file")]),
    "det": lambda df: ranking.det_curve(df),
}


@pytest.mark.parametrize("name", REPORTS)
def test_ranges_give_what_windows_give(scored, name, monkeypatch):
    shown = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())
    assert ranking.n_ranges(scored) == 1
    whole = shown(REPORTS[name](scored))
    in_ranges(monkeypatch)
    assert ranking.n_ranges(scored) > 1
    assert shown(REPORTS[name](scored)) == whole and whole


def test_ranges_hold_about_equally_many(scored, monkeypatch):
    in_ranges(monkeypatch)
    ties = ranking.tie_groups(scored, ["class"])
    found = {r["range"]: r["count"] for r in ranking.in_ranges(ties, "s", "range", 7).groupBy("range").count().collect()}
    assert found[-1] == 1 and len(found) == 8 and max(found.values()) < 2.5 * ties.count() / 7


@pytest.mark.parametrize("cut", [False, True])
def test_nothing_runs_before_a_report_is_asked_for(spark, scored, cut, monkeypatch):
    if cut:
        in_ranges(monkeypatch)
    tracker = spark.sparkContext.statusTracker()
    group = f"plans {cut}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        reports = evaluation.evaluate(scored)
        assert list(tracker.getJobIdsForGroup(group)) == []
        reports["classes"].collect()
        assert list(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_estimates_follow_the_files(spark, scored):
    from corvane.session import estimated_bytes

    assert 0 < estimated_bytes(scored) < 1_000_000
    assert ranking.n_ranges(spark.createDataFrame([], "s double")) in (1, ranking.RANGES)
