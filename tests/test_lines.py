"""Devices that print over sockets: reopened connections, deadlines and gaps without a further line, restarts."""

import json
import socket
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import telemetry
from corvane.streaming import device, lines


class Board(threading.Thread):
    """Prints a script of (seconds to wait, text or None to hang up) to whoever is connected."""

    def __init__(self, script):
        super().__init__(daemon=True)
        self.script, self.server = script, socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]

    def run(self):
        peer = self.server.accept()[0]
        for wait, text in self.script:
            time.sleep(wait)
            if text is None:
                peer.close()
                peer = self.server.accept()[0]
            else:
                peer.sendall(text.encode())
        time.sleep(60)


def address(boards):
    return ",".join(f"{name}=127.0.0.1:{b.port}" for name, b in boards.items())


def test_connections_are_reopened_and_numbering_goes_on(tmp_path):
    board = Board([(0, "one\ntwo\r\nhal"), (0.2, None), (0.1, "three\n"), (0.1, "four\n")])
    board.start()
    options = {"devices": address({"d": board}), "spool": str(tmp_path / "spool"), "poll": "0.4"}
    reader = lines.LineReader(options)
    end, until = reader.latestOffset(), time.time() + 8
    while time.time() < until and reader.next_line.get("d", 0) < 4:
        end = reader.latestOffset()
    rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [(r[0], r[1], r[3]) for r in rows] == [("d", i, x) for i, x in enumerate(["one", "two", "three", "four"])]
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    reader.stop()
    again = lines.LineReader(options | {"devices": "d=127.0.0.1:1"})
    assert again.latestOffset() == end and again.next_line == {"d": 4}
    assert [r for p in again.partitions({"turn": 0}, end) for r in again.read(p)] == rows


def test_runs_end_by_the_clock(spark, tmp_path):
    done = telemetry.MARKER + "\n"
    boards = {
        "full": Board([(0.2, "a\n"), (0.2, done), (0.1, "".join(f"s{i}\n" for i in range(9)))]),
        "gap": Board([(0.2, "a\nb\n"), (0.3, done + "s0\n"), (2.5, "late\n")]),
        "silent": Board([(0.2, "a\nb\nc\n")]),
        "reset": Board([(0.2, "a\n"), (0.1, None), (0.2, "b\n" + done), (2.5, "late\n")]),
    }
    for b in boards.values():
        b.start()
    spark.dataSource.register(lines.DeviceLines)
    stream = spark.readStream.format("devicelines").option("devices", address(boards)).option("spool", str(tmp_path / "spool")).option("poll", "0.3").load()
    with device.stateful(spark):
        query = device.live_captures(stream, 4.0).writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()
        try:
            until = time.time() + 75
            while time.time() < until and query.isActive:
                time.sleep(0.5)
                if Path(tmp_path / "rows").exists() and len(list(Path(tmp_path / "rows").glob("*.parquet"))):
                    ended = spark.read.schema(device.CAPTURES).parquet(str(tmp_path / "rows")).where("ended IS NOT NULL").select("device").distinct().count()
                    if ended == 4:
                        break
        finally:
            query.stop()
    rows = spark.read.schema(device.CAPTURES).parquet(str(tmp_path / "rows"))
    ends = {r["device"]: r["ended"] for r in rows.where("ended IS NOT NULL").collect()}
    assert ends == {"full": "marker", "gap": "gap", "silent": "deadline", "reset": "gap"}
    kept = {r["device"]: r["n"] for r in rows.where("ended IS NULL").groupBy("device").agg(F.count("*").alias("n")).collect()}
    assert kept == {"full": 7, "gap": 4, "silent": 3, "reset": 3}
    # The same as of the batch, over all that was spooled.
    spooled = [r for f in sorted(Path(tmp_path / "spool").glob("*.json")) for r in json.loads(f.read_text())["rows"]]
    batch = telemetry.captured(spark.createDataFrame([tuple(r) for r in spooled], device.TIMED_LINES), 4.0)
    shown = lambda df: sorted((r["device"], r["line_no"], r["line"]) for r in df.collect())
    assert shown(batch) == shown(rows.where("ended IS NULL"))


@pytest.mark.parametrize("gaps, kept", [((0.1,) * 9, 6), ((0.1, 0.1, 1.01, 0.1), 3), ((2.0,), 1), ((0.9, 0.99, 0.5, 0.9, 0.9, 0.9), 6)])
def test_a_silence_after_the_marker_ends_a_run(spark, gaps, kept):
    at, rows = 1.0, [("d", 0, 0.5, "a"), ("d", 3, 1.0, telemetry.MARKER)]
    for i, g in enumerate(gaps):
        at += g
        rows.append(("d", 4 + 2 * i, at, f"s{i}"))
    found = telemetry.captured(spark.createDataFrame(rows, device.TIMED_LINES), 60.0)
    assert found.count() == 1 + kept


def test_lines_of_a_device_are_in_order_in_any_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(device, "RANGE_LINES", 40)
    df = spark.createDataFrame([(f"d{i % 3}", i // 3, f"x{i}") for i in range(300)], device.LINES).repartition(7)
    device.write_lines(df, str(tmp_path))
    files = sorted(Path(tmp_path).glob("*.json"), key=lambda f: f.stat().st_mtime_ns)
    seen = {}
    for f in files:
        for row in map(json.loads, f.read_text().splitlines()):
            assert row["line_no"] == seen.get(row["device"], -1) + 1
            seen[row["device"]] = row["line_no"]
    assert seen == {"d0": 99, "d1": 99, "d2": 99}
