"""Captures of devices with many lines: dealt by ranges of line numbers, the same at every cut."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.operators import telemetry
from corvane.plans import telemetry as plans
from corvane.streaming import device

TIMEOUT = 6.0
SMALL = Path("/root/testdata/sf0.001")


def plain(rows):
    """Lines of one device's run, read one after the other."""
    kept, deadline, left, last = [], rows[0][2] + TIMEOUT, None, None
    for row in rows:
        if left == 0 or (row[2] >= deadline if left is None else row[2] - last > telemetry.GAP_SECONDS):
            break
        kept.append(row)
        last = row[2]
        if left is not None:
            left -= 1
        elif telemetry.MARKER in row[3]:
            left = telemetry.AFTER_MARKER
    return kept


def logs(n):
    """Devices with holes in their numbers, markers and silences anywhere."""
    chance, rows = random.Random(3), {}
    for i in range(n):
        number, at, own = chance.randrange(9), chance.random(), []
        for _ in range(chance.randrange(1, 40)):
            own.append((f"d{i}", number, at, f"  {telemetry.MARKER}" if chance.random() < 0.08 else "x"))
            number += chance.choice([1, 1, 1, 2, 9])
            at += chance.choice([0.1, 0.1, 0.3, 1.0, 1.5])
        rows[f"d{i}"] = own
    return rows


@pytest.mark.parametrize("size", [1, 3, 50_000])
def test_captures_are_the_same_at_every_cut(spark, monkeypatch, size):
    monkeypatch.setattr(telemetry, "RANGE_LINES", size)
    rows = logs(150)
    df = spark.createDataFrame([x for own in rows.values() for x in own], device.TIMED_LINES).repartition(5)
    wanted = sorted(x for own in rows.values() for x in plain(own))
    assert sorted(tuple(r) for r in telemetry.captured(df, TIMEOUT).collect()) == wanted


def test_lines_of_one_device_are_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "RANGE_LINES", 100)
    df = spark.createDataFrame([("d", i, i / 1000, telemetry.MARKER if i == 3950 else "x") for i in range(4000)], device.TIMED_LINES).repartition(4)
    with session.settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="8"):
        found = telemetry.captured(df, 60.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 3956
    assert max(r["count"] for r in found) < 2000


def exchanged(plan):
    """Rows through each exchange by a device alone in a plan that has run."""
    found = [int(plan.metrics().apply("shuffleRecordsWritten").value())] if re.match(r"Exchange hashpartitioning\(device#\d+L?, \d+\)", plan.simpleString(1000)) else []
    return found + [n for i in range(plan.children().size()) for n in exchanged(plan.children().apply(i))]


@pytest.mark.skipif(not SMALL.exists(), reason="no tables")
def test_lines_of_the_query_are_not_dealt_by_device_alone(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "RANGE_LINES", 20)
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    with session.settings(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        df = plans.s19_serial_capture(spark, str(SMALL))
        assert df.collect()
        rows = exchanged(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= events  # those that are numbered: there are four lines of each
