"""Device lines as a stream: the same results as the batch parser, as lines arrive."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.session import settings, shared_dir
from corvane.operators.telemetry import AFTER_MARKER, DETECTION_LINE, FILE_LINE, GAP_SECONDS, MARKER

LINES = "device string, line_no long, line string"
DETECTIONS = "device string, file_no int, file string, rank int, label string, score double"
TIMED_LINES = "device string, line_no long, at double, line string"
CAPTURES = TIMED_LINES + ", ended string"

#: Seconds that timers wait beyond their time.
SLACK_SECONDS = 0.3
#: Line numbers of a range: a device's lines of one range are one file, and ranges are written one after the other.
RANGE_LINES = 200_000
#: Bytes of files that a turn of a stream takes, or one file: what tasks put in order together, however long devices print.
BATCH_BYTES = 128 << 20
#: Rows that a task gives on together.
GIVEN_ROWS = 10_000
#: Partitions of a stream's state, on clusters with fewer cores: of so many, few devices share one.
STATE_PARTITIONS = 16


def staged_lines(rows: DataFrame) -> DataFrame:
    """Rows of lines, worked out once into a table by range of line numbers."""
    staged = f"{shared_dir(rows.sparkSession)}/lines-{uuid.uuid4().hex}"
    cut = rows.withColumn("__range", F.floor(F.col("line_no") / RANGE_LINES))
    cut.hint("rebalance", "__range", "device").write.partitionBy("__range").parquet(staged)
    return rows.sparkSession.read.schema(cut.schema).parquet(staged)


def write_staged(staged: DataFrame, folder: str) -> None:
    """Rows of a table by range as JSON files that a stream may read in any cut: each device's lines are in order, within files and from
    file to file. Each range is read once."""
    ranges = sorted(r[0] for r in staged.where(F.col("__range").isNotNull()).select("__range").distinct().collect())
    for part in ranges or [0]:
        own = staged.where(F.col("__range") == part).drop("__range")
        own.repartition("device").sortWithinPartitions("device", "line_no").write.mode("append").json(folder)


def write_lines(rows: DataFrame, folder: str) -> None:
    """Rows of lines as files that a stream may read: see `write_staged`."""
    write_staged(staged_lines(rows), folder)


def read_lines(spark: SparkSession, folder: str, bytes_per_batch: int | None = None, schema: str = LINES) -> DataFrame:
    """JSON rows of LINES from files that appear in a folder, about BATCH_BYTES a turn unless told otherwise."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch or BATCH_BYTES).json(folder)


# The stream's driver-side Python process does not have this package on its path unless its environment says so:
# what is defined here travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pieces(lines: DataFrame, pattern: str = "") -> DataFrame:
    """`lines` with a row for each device and Arrow batch: device, and an array of each other column, by line number; with `pattern`, of
    lines that match it. Python takes the rows of a stateful operator one at a time, but an array as it is."""
    names = [c for c in lines.columns if c != "device"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pattern:
                batch = batch.filter(pc.match_substring_regex(batch.column("line"), pattern))
            batch = batch.take(pc.sort_indices(batch, [("device", "ascending"), ("line_no", "ascending")]))
            runs = pc.run_end_encode(batch.column("device"))
            offsets = pa.array([0, *runs.run_ends.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([runs.values, *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in names)], ["device", *names])

    return lines.mapInArrow(pack, T.StructType([lines.schema["device"], *(T.StructField(c, T.ArrayType(lines.schema[c].dataType)) for c in names)]))


def in_order(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    """These columns of a device's rows of one turn, lines or pieces of them, by line number."""
    names = ["line_no", *columns]
    held = pd.concat([x[names] for x in rows])
    if held["line_no"].dtype == object:
        held = pd.DataFrame({c: np.concatenate(held[c].to_numpy()) for c in names})
    return held.sort_values("line_no", kind="stable", ignore_index=True)


def groups(pattern: str, lines: pa.Array) -> list[pa.Array]:
    """What the groups of `pattern` hold in each line; null where it does not match."""
    return pc.extract_regex(lines, re.sub(r"(?<!\\)\(", lambda m: f"(?P<g{m.start()}>", pattern)).flatten()


def frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """`rows` in frames of GIVEN_ROWS, one at least."""
    for i in range(0, max(1, len(rows)), GIVEN_ROWS):
        yield pd.DataFrame(rows[i : i + GIVEN_ROWS], columns=columns)


class FileFollower(StatefulProcessor):
    """Keeps a device's current file and how many detections it has; puts a turn's lines in order first."""

    def __init__(self, threshold: float = 0.01, k: int = 5):
        self.threshold, self.k = threshold, k
        self.file_line, self.detection_line, self.marker = FILE_LINE, DETECTION_LINE, MARKER
        self.columns = [x.split()[0] for x in DETECTIONS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "file_no int, file string, found int, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, name, found, done = self.current.get() if self.current.exists() else (None, None, 0, False)
        out = pd.DataFrame(columns=self.columns)
        if not done:
            lines = pa.array(in_order(rows, "line")["line"], pa.string())
            end = pc.index(pc.match_substring(lines, self.marker), True).as_py()
            lines = lines if end < 0 else lines[: end + 1]
            numbers, _, names = groups(self.file_line, lines)
            _, labels, scores = groups(self.detection_line, lines)
            number_like = pc.match_substring_regex(scores, r"^(\d+\.?\d*|\.\d+)$")
            # At place 0, before the turn's lines, stands what is known of those before: their last file, with `found` detections.
            scores = np.append(np.nan, pc.if_else(number_like, scores, None).cast(pa.float64()).to_numpy(False) / 100)
            numbers = pa.concat_arrays([pa.array([number], pa.int32()), numbers.cast(pa.int32())])
            names = pa.concat_arrays([pa.array([name], pa.string()), names])
            heads = names.is_valid().to_numpy(False)
            under = np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))
            hits = (scores >= self.threshold) & ~heads & heads[under]
            count = np.cumsum(hits)
            ranks = count - count[under] + np.where(under == 0, found, 0)
            at = np.flatnonzero(hits & (ranks <= self.k))
            of = pa.array(under[at])
            given = (key[0], numbers.take(of).to_numpy(False), names.take(of).to_pandas(), ranks[at], labels.take(pa.array(at - 1)).to_pandas(), scores[at])
            out = pd.DataFrame(dict(zip(self.columns, given, strict=True)))
            number, name = numbers[under[-1]].as_py(), names[under[-1]].as_py()
            found, done = int(min(ranks[-1], self.k)), end >= 0
        self.current.update((number, name, found, done))
        for i in range(0, max(1, len(out)), GIVEN_ROWS):
            yield out[i : i + GIVEN_ROWS]

    def close(self) -> None:
        pass


class Capture(StatefulProcessor):
    """Passes a device's lines on until its deadline or the marker, and after that the few lines that come without a gap.

    With `live`, timers end a run whose deadline passes, or whose marker is followed by nothing for `gap` seconds, also when no
    further line comes; how a run ended is a row of its own."""

    def __init__(self, timeout: float, live: bool = False):
        self.timeout, self.live, self.marker, self.after, self.gap, self.slack = timeout, live, MARKER, AFTER_MARKER, GAP_SECONDS, SLACK_SECONDS
        self.columns = [x.split()[0] for x in (CAPTURES if live else TIMED_LINES).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "deadline double, left int, last double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.current.exists()
        deadline, left, last, done = self.current.get() if known else (None, -1, None, False)
        out, ended, were = [], None, done
        for number, at, line in () if done else in_order(rows, "at", "line").itertuples(index=False, name=None):
            deadline = at + self.timeout if deadline is None else deadline
            if done:
                break
            if left < 0 and at >= deadline or left >= 0 and at - last > self.gap:
                done, ended = True, "deadline" if left < 0 else "gap"
                break
            out.append((key[0], number, at, line))
            last = at
            if left >= 0:
                left -= 1
            elif self.marker in line:
                left = self.after
            if left == 0:
                done, ended = True, "marker"
        self.current.update((deadline, left, last, done))
        if not self.live:
            yield from frames(out, self.columns)
            return
        out = [(*x, None) for x in out]
        if done and not were:
            out.append((key[0], None, None, None, ended))
        if not done:
            now = timerValues.getCurrentProcessingTimeInMs()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # Lines that came before a turn began are handled before its timers; SLACK_SECONDS are for those that came as it did.
            self.handle.registerTimer(max(now + 1, int(1000 * ((last + self.gap if left >= 0 else deadline) + self.slack))))
        yield from frames(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        deadline, left, last, done = self.current.get()
        self.current.update((deadline, left, last, True))
        out = [] if done else [(key[0], None, None, None, "deadline" if left < 0 else "gap")]
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def captured(lines: DataFrame, timeout: float) -> DataFrame:
    """TIMED_LINES of a stream of them that belong to each device's run, by the lines' own times: see `telemetry.captured`. A query
    that is started again on its checkpoint goes on where a lost connection left it. Needs the RocksDB state store."""
    return pieces(lines).groupBy("device").transformWithStateInPandas(Capture(timeout), outputStructType=TIMED_LINES, outputMode="Append", timeMode="none")


def live_captures(lines: DataFrame, timeout: float) -> DataFrame:
    """CAPTURES of a stream of lines as they arrive (`at` is the clock): the lines of each device's run, and a row that says how it
    ended, by the clock also where no further line comes. Needs the RocksDB state store."""
    return pieces(lines).groupBy("device").transformWithStateInPandas(Capture(timeout, True), outputStructType=CAPTURES, outputMode="Append", timeMode="ProcessingTime")


def detections(lines: DataFrame, threshold: float = 0.01, k: int = 5) -> DataFrame:
    """DETECTIONS of a stream of LINES; a device's lines end with the marker. Needs the RocksDB state store."""
    return pieces(lines, f"{FILE_LINE}|{DETECTION_LINE}|{re.escape(MARKER)}").groupBy("device").transformWithStateInPandas(FileFollower(threshold, k), outputStructType=DETECTIONS, outputMode="Append", timeMode="none")


def windowed_scores(events: DataFrame, time: str, value: str, by: str, width: str = "3 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Overlapping windows of a stream of scores: by, start, end, mean and best of `value`; rows later than `late` do not count."""
    held = events.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), by)
    return held.agg(F.avg(value).alias("mean"), F.max(value).alias("best")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "best")


def stateful(spark: SparkSession):
    """The RocksDB state store for the streams started inside, in no more partitions than work at once: each starts Python and commits a
    store at every turn, also where it has no lines. A stream that goes on from a checkpoint keeps the number that it began with."""
    most = max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    return settings(
        spark,
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        spark__sql__shuffle__partitions=str(min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    )


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now, into a Parquet table in `folder`, beside its checkpoint; its rows."""
    with stateful(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def updated(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """As `drained` for aggregates that are not over: each turn's changed rows are written, and the last of each key counts."""
    def write(rows: DataFrame, turn: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/turn={turn}")  # a turn that is run again replaces its rows

    with stateful(stream.sparkSession):
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("turn", T.IntegerType())])
    last = F.max_by(F.struct(*stream.columns), "turn").alias("r")
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows").groupBy(*keys).agg(last).select("r.*")


def climbed(turns: DataFrame, by: str, order: list[str], least: int = 128, most: int = 4096, target_free: float = 8.0) -> DataFrame:
    """by, in_flight: what `backpressure` gives for each series of rows (by, throughput, memory_free) in their order, read as it
    comes: a task holds a series' state, never a series."""
    kind = turns.schema[by].dataType.simpleString()

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started = None, False
        n, way, step, last = 0, 1, 0, None
        for batch in batches:
            keys, done = [], []
            for own, value, free in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or own != key:
                    if started:
                        keys.append(key)
                        done.append(n)
                    key, started = own, True
                    n, way, step, last = least, 1, max(32, min(512, least // 2)), None
                half = max(16, step // 2)
                short, rising = 0 < free < target_free, last is not None and value >= last * 1.01
                if short:
                    n, way, step = int(n * 0.8), -1, half
                elif last is None or rising:
                    n, way = n + step if last is None or way >= 0 else n - step, 1 if last is None else way
                else:
                    n, way, step = n - half if way >= 0 else n + half, -way if way else -1, half
                n, last = max(least, min(most, n)), float(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, turns_type), pa.array(done, pa.int32())], [by, "in_flight"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([key], turns_type), pa.array([n], pa.int32())], [by, "in_flight"])

    turns_type = to_arrow_type(turns.schema[by].dataType)
    rows = turns.repartition(by).sortWithinPartitions(by, *order).select(by, F.col("throughput").cast("double").alias("throughput"), F.coalesce(F.col("memory_free").cast("double"), F.lit(0.0)).alias("memory_free"))
    return rows.mapInArrow(climb, f"`{by}` {kind}, in_flight int")


def backpressure(series: Column, least: int = 128, most: int = 4096, target_free: float = 8.0) -> Column:
    """Items in flight after a series of (throughput, memory_free), from `least` on: hill climbing.

    Memory free under the target (0: not known): a fifth less. The first turn probes upwards. Throughput at
    least 1 % over the turn before: on in the same direction, else back. Memory and turning back halve the step.
    """
    first = max(32, min(512, least // 2))

    def turn(acc: Column, x: Column) -> Column:
        n, way, by = acc["n"], acc["way"], acc["by"]
        half = F.greatest(F.lit(16), F.floor(by / 2).cast("int"))
        short = (x["memory_free"] > 0) & (x["memory_free"] < target_free)
        probe, rising = acc["last"].isNull(), x["throughput"] >= acc["last"] * 1.01
        keep = probe | rising
        onward = F.when(probe | (way >= 0), n + by).otherwise(n - by)
        turned = F.when(way >= 0, n - half).otherwise(n + half)
        moved = F.when(short, F.floor(n * 0.8).cast("int")).when(keep, onward).otherwise(turned)
        return F.struct(
            F.greatest(F.lit(least), F.least(F.lit(most), moved)).cast("int").alias("n"),
            F.when(short, -1).when(probe, 1).when(rising, way).otherwise(-way).cast("int").alias("way"),
            F.when(short | ~keep, half).otherwise(by).cast("int").alias("by"),
            x["throughput"].cast("double").alias("last"),
        )

    start = F.struct(F.lit(least).alias("n"), F.lit(1).alias("way"), F.lit(first).alias("by"), F.lit(None).cast("double").alias("last"))
    return F.aggregate(series, start, turn, lambda acc: acc["n"])
