"""Turns of streams are bounded by bytes, and lines are worked out once, however long devices print."""

from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import telemetry
from corvane.streaming import device


def printed(spark, n):
    """Lines of three devices, the first of which prints most."""
    rows = spark.range(0, n, 1, 5).select(F.when(F.col("id") % 10 < 8, "d0").otherwise(F.concat(F.lit("d"), F.col("id") % 10)).alias("device"), "id")
    head = F.concat(F.lit("["), F.floor(F.col("line_no") / 4), F.lit("/99] f"), "line_no")
    texts = F.array(head, F.lit("    [1] a: 50.0%"), F.lit("    [2] b: 1.0%"), F.lit("    [3] c: 40.0%"))
    order = F.row_number().over(Window.partitionBy("device").orderBy("id")) - 1
    return rows.select("device", order.cast("long").alias("line_no")).withColumn("line", F.get(texts, (F.col("line_no") % 4).cast("int")))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(device, "RANGE_LINES", 100)
    monkeypatch.setattr(device, "BATCH_BYTES", 12_000, raising=False)


def turns(spark, stream, folder):
    """Rows of each turn of a stream over what is there, and all that it gave."""
    with device.stateful(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress], spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def test_a_turn_takes_a_bounded_part_of_a_devices_lines(spark, tmp_path, small):
    lines = printed(spark, 3000)
    device.write_lines(lines, f"{tmp_path}/lines")
    taken, found = turns(spark, device.detections(device.read_lines(spark, f"{tmp_path}/lines"), 0.3, 2), tmp_path)
    assert sum(taken) == 3000 and max(taken) <= 400  # bytes of a line: 45 and more
    shown = lambda df: sorted(tuple(r[c.split()[0]] for c in device.DETECTIONS.split(", ")) for r in df.collect())
    assert shown(found) == shown(telemetry.detections(lines, 0.3, 2))


def test_lines_are_worked_out_once(spark, tmp_path, small):
    seen = tmp_path / "seen"

    def told(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.write("".join(f"{a} {b}\n" for a, b in zip(batch["device"].to_pylist(), batch["line_no"].to_pylist(), strict=True)))
            yield batch

    device.write_lines(printed(spark, 3000).mapInArrow(told, device.LINES), f"{tmp_path}/lines")
    times = Counter(seen.read_text().splitlines())
    assert len(times) == 3000 and set(times.values()) == {1}


def test_no_lines(spark, tmp_path):
    device.write_lines(printed(spark, 0), f"{tmp_path}/lines")
    assert Path(tmp_path / "lines").exists()
    taken, found = turns(spark, device.detections(device.read_lines(spark, f"{tmp_path}/lines"), 0.3, 2), tmp_path)
    assert sum(taken) == 0 and found.count() == 0


class Handle:
    """A value state by itself."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("made", [lambda: device.Capture(4.0), lambda: device.FileFollower()])
def test_nothing_is_held_of_what_comes_after_the_end(made):
    one, handle = made(), Handle()
    one.init(handle)
    texts = ["a", f"  {telemetry.MARKER}", *"bcdefgh"]
    first = pd.DataFrame({"device": "d", "line_no": range(9), "at": [i / 10 for i in range(9)], "line": texts})
    given = pd.concat(list(one.handleInputRows(("d",), iter([first.iloc[5:], first.iloc[:5]]), None)))
    assert list(given.get("line_no", [])) in ([], list(range(7)))
    later = iter([first, first])
    assert sum(len(x) for x in one.handleInputRows(("d",), later, None)) == 0
    assert len(list(later)) == 2


def test_a_capture_goes_on_over_bounded_turns(spark, tmp_path, small):
    marked = F.when((F.col("device") == "d0") & (F.col("line_no") == 1000), telemetry.MARKER).otherwise(F.col("line"))
    lines = printed(spark, 3000).select("device", "line_no", (F.col("line_no") / 100).alias("at"), marked.alias("line"))
    device.write_lines(lines, f"{tmp_path}/lines")
    taken, found = turns(spark, device.captured(device.read_lines(spark, f"{tmp_path}/lines", schema=device.TIMED_LINES), 15.0), tmp_path)
    assert sum(taken) == 3000 and max(taken) <= 400
    shown = lambda df: sorted((r["device"], r["line_no"], r["at"], r["line"]) for r in df.collect())
    assert shown(found) == shown(telemetry.captured(lines, 15.0))
    assert found.where("device = 'd0'").count() == 1006
