"""A turn of a stream costs what its lines cost: state in few partitions, lines in pieces, lines worked out once."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.operators import telemetry
from corvane.plans import telemetry as plans
from corvane.streaming import device
from tests.test_captures import exchanged
from tests.test_turns import Handle, printed


def run(stream, folder, partitions):
    """The last turn's plan and partitions of state, of a session with so many for shuffles."""
    with session.settings(stream.sparkSession, spark__sql__shuffle__partitions=str(partitions)), device.stateful(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return query._jsq.lastProgress(), query._jsq.streamingQuery().lastExecution().executedPlan()


@pytest.mark.parametrize("kind", ["detections", "captured"])
def test_turns_do_not_cost_by_the_sessions_partitions(spark, tmp_path, kind):
    lines = printed(spark, 3000).withColumn("at", F.col("line_no") / 100)
    device.write_lines(lines.select("device", "line_no", "at", "line"), f"{tmp_path}/lines")
    stream = device.read_lines(spark, f"{tmp_path}/lines", schema=device.TIMED_LINES)
    progress, plan = run(device.detections(stream.drop("at"), 0.3, 2) if kind == "detections" else device.captured(stream, 1e9), tmp_path, 200)
    assert progress.stateOperators()[0].numShufflePartitions() == device.STATE_PARTITIONS
    assert 3 <= sum(exchanged(plan)) <= 30  # three devices, few tasks, one batch each; before: a row a line


def test_partitions_are_no_more_than_the_sessions(spark):
    with session.settings(spark, spark__sql__shuffle__partitions="3"), device.stateful(spark):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"


def test_pieces_hold_all_lines_in_order(spark):
    rows = [(None if i % 7 == 0 else f"d{i % 3}", i if i % 5 else None, None if i % 11 == 0 else f"x{i}") for i in range(400)]
    random.Random(4).shuffle(rows)
    with session.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="50"):
        found = device.pieces(spark.createDataFrame(rows, device.LINES).repartition(3)).collect()
    assert len(found) < 60
    assert Counter(rows) == Counter((r["device"], n, x) for r in found for n, x in zip(r["line_no"], r["line"], strict=True))
    assert all(n == sorted(n) for n in ([x for x in r["line_no"] if x is not None] for r in found))


def plain(lines, threshold, k):
    """Detections of a device's lines, read one after the other."""
    number = name = None
    found, out = 0, []
    for line in lines:
        if line is None:
            continue
        if head := re.match(telemetry.FILE_LINE, line):
            number, name, found = int(head[1]), head[3], 0
        elif name is not None and (hit := re.match(telemetry.DETECTION_LINE, line)) and hit[3].count(".") < 2 and hit[3] != ".":
            score = float(hit[3]) / 100
            if score >= threshold and found < k:
                found += 1
                out.append(("d", number, name, found, hit[2], score))
        if telemetry.MARKER in line:
            break
    return out


def test_followers_read_as_one_line_after_the_other():
    chance = random.Random(1)
    for _ in range(300):
        texts = ["    [2] b: 1.2.3%", "    [2] c: .%", "    [1] q: .5%", "    [1] q: 75.%", "    [2] bird: 50.0%", None, "z", "  [BENCH] read=1ms", "[0/9] zero"]
        kinds = [lambda: f"[{chance.randrange(9)}/9] f{chance.randrange(99)}", lambda: f"    [1] a b: {chance.uniform(0, 99):.2f}%", lambda: chance.choice(texts), lambda: telemetry.MARKER if chance.random() < 0.2 else "x"]
        lines = [chance.choice(kinds)() for _ in range(chance.randrange(1, 40))]
        follower, at, found = device.FileFollower(0.3, 2), 0, []
        follower.init(Handle())
        while at < len(lines):
            end = min(len(lines), at + chance.randrange(1, 9))
            turn = pd.DataFrame({"device": "d", "line_no": range(at, end), "line": lines[at:end]})
            if chance.random() < 0.5:
                turn = pd.DataFrame({"device": ["d"], "line_no": [turn["line_no"].to_numpy()], "line": [turn["line"].to_numpy()]})
            for given in follower.handleInputRows(("d",), iter([turn]), None):
                found += given.itertuples(index=False, name=None)
            at = end
        assert found == plain(lines, 0.3, 2)


def test_a_restarted_capture_works_its_lines_out_once(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def told(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.write("".join(f"{a} {b}\n" for a, b in zip(batch["device"].to_pylist(), batch["line_no"].to_pylist(), strict=True)))
            yield batch

    lines = printed(spark, 3000).select("device", "line_no", (F.col("line_no") / 100).alias("at"), "line")
    monkeypatch.setattr(plans, "timed_lines", lambda *_: lines.mapInArrow(told, device.TIMED_LINES))
    found = plans.r1_serial_capture(spark, "").groupBy("device").count().collect()
    assert {r["device"]: r["count"] for r in found} == {"d0": 400, "d8": 300, "d9": 300}
    assert set(Counter(seen.read_text().splitlines()).values()) == {1}
