"""Lines a device prints, as rows: files, detections, timings and totals.

Lines are rows (device, line_no, line). A detection or timing belongs to the last file line before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lines' formats.
FILE_LINE = r"^\[(\d+)/(\d+)\]\s+(.+)$"
DETECTION_LINE = r"^\s+\[(\d+)\]\s+(.+?):\s+([\d.]+)%$"
TIMING_LINE = r"^\s+\[BENCH\]\s+read=(\d+)ms\s+stft=(\d+)ms\s+npu=(\d+)ms\s+total=(\d+)ms$"
TOTALS_LINE = r"^Processed:\s+(\d+)\s*/\s*(\d+)\s+files\s+\((\d+)\s+errors\)"
AVERAGES_LINE = r"^Benchmark:.*avg read=(\d+)ms\s+stft=(\d+)ms\s+npu=(\d+)ms\s+total=(\d+)ms\)$"
TIMES = ("read_ms", "stft_ms", "npu_ms", "total_ms")
# What a run ends with, and how many lines are read after that.
MARKER, AFTER_MARKER = "=== DONE ===", 5
# Fixed value: more seconds than these without a line, after the marker, end a run.
GAP_SECONDS = 1.0

#: Lines of one device that are looked through together; what they begin under comes from those before.
RANGE_LINES = 50_000


def part(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", pattern, group)


def _is(pattern: str) -> Column:
    return F.regexp_like("line", F.lit(pattern))


def with_files(lines: DataFrame) -> DataFrame:
    """`lines` with file and file_no of the last file line so far; null before the first.

    A device's log is cut into ranges of line numbers: each is ordered on its own, and begins under the last
    file line of the ranges before it (one row a range is ordered by device).
    """
    own = Window.partitionBy("device", "__range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("device").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(_is(FILE_LINE), F.struct(part(FILE_LINE, 3).alias("file"), part(FILE_LINE, 1).cast("int").alias("file_no")))
    cut = lines.withColumn("__range", F.floor(F.col("line_no") / RANGE_LINES))
    ends = cut.groupBy("device", "__range").agg(F.max_by(head, F.when(head.isNotNull(), F.col("line_no"))).alias("__end"))
    carried = ends.select("device", "__range", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    found = cut.withColumn("__head", F.last(head, ignorenulls=True).over(own)).join(carried, ["device", "__range"])
    under = F.coalesce("__head", "__carried")
    return found.select(*lines.columns, under["file"].alias("file"), under["file_no"].alias("file_no"))


def captured(lines: DataFrame, timeout: float) -> DataFrame:
    """The lines (device, line_no, at in seconds, line) of each device's run: from its first line until `timeout` seconds later or the
    line with the marker, whichever comes first, and at most AFTER_MARKER lines after the marker, up to the first gap of more than GAP_SECONDS.

    As in `with_files`, lines are dealt by device and range of line numbers, never by device alone: what holds for a device is taken
    from a row a range, and the few lines after its marker from the marker's range and the next that have any.
    """
    keys = ["device", "__range"]
    ranges = Window.partitionBy("device")
    # A line without a number counts for the deadline and ends with it; it is in no order.
    cut = lines.withColumn("__range", F.coalesce(F.floor(F.col("line_no") / RANGE_LINES), F.lit(0)))
    firsts = cut.groupBy(*keys).agg(F.min("at").alias("__first"), F.count("line_no").alias("__n"))
    spans = firsts.select(*keys, "__n", (F.min("__first").over(ranges) + timeout).alias("__deadline"))
    marked = cut.join(spans, keys).where((F.col("at") < F.col("__deadline")) & F.contains("line", F.lit(MARKER)))
    marks = marked.groupBy("device").agg(F.min("line_no").alias("__mark"))
    past = F.col("__range") - F.floor(F.col("__mark") / RANGE_LINES)
    between = F.sum(F.when(past > 0, F.col("__n"))).over(ranges.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    near = (past >= 0) & (F.coalesce(between, F.lit(0)) < AFTER_MARKER)
    tails = spans.join(marks, "device", "left").select(*keys, F.when(near, F.col("__mark")).alias("__mark"))
    order = Window.partitionBy("device").orderBy("line_no")  # over two full ranges at most
    after = cut.join(tails, keys).where(F.col("line_no") >= F.col("__mark")).select("device", "line_no", "at")
    few = after.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= AFTER_MARKER + 1)  # the marker's line is the first
    gap = F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(0.0)) > GAP_SECONDS
    going = F.max(gap).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = few.withColumn("__over", going).where(~F.col("__over")).groupBy("device").agg(F.max("line_no").alias("__last"))
    kept = cut.join(spans.join(ends, "device", "left"), keys)
    until = F.coalesce(F.col("line_no") <= F.col("__last"), F.col("at") < F.col("__deadline"))
    return kept.where(until).select(*lines.columns)


def detections(lines: DataFrame, threshold: float = 0.01, k: int = 5) -> DataFrame:
    """device, file_no, file, rank, label, score: the first `k` detections of each file from the threshold on, as printed."""
    found = with_files(lines).where(_is(DETECTION_LINE) & F.col("file").isNotNull())
    scores = found.select("device", "file_no", "file", "line_no", part(DETECTION_LINE, 2).alias("label"), (F.try_to_number(part(DETECTION_LINE, 3), F.lit("999999.999999")).cast("double") / 100).alias("score"))
    order = Window.partitionBy("device", "file_no", "file").orderBy("line_no")
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("line_no")


def timings(lines: DataFrame) -> DataFrame:
    """device, file_no, file and milliseconds of its stages; the last line of a file counts."""
    found = with_files(lines).where(_is(TIMING_LINE) & F.col("file").isNotNull())
    times = F.struct(*(part(TIMING_LINE, i + 1).cast("int").alias(n) for i, n in enumerate(TIMES)))
    return found.groupBy("device", "file_no", "file").agg(F.max_by(times, "line_no").alias("t")).select("device", "file_no", "file", "t.*")


def totals(lines: DataFrame) -> DataFrame:
    """device, processed, total, errors, and the averages the device states; the last lines count; null where there is none."""
    numbers = lambda p, names: F.struct(*(part(p, i + 1).cast("int").alias(n) for i, n in enumerate(names)))
    return lines.groupBy("device").agg(
        F.max_by(F.when(_is(TOTALS_LINE), numbers(TOTALS_LINE, ("processed", "total", "errors"))), F.when(_is(TOTALS_LINE), F.col("line_no"))).alias("a"),
        F.max_by(F.when(_is(AVERAGES_LINE), numbers(AVERAGES_LINE, [f"avg_{t}" for t in TIMES])), F.when(_is(AVERAGES_LINE), F.col("line_no"))).alias("b"),
    ).select("device", "a.*", "b.*")


def results(lines: DataFrame, threshold: float = 0.01, k: int = 5) -> DataFrame:
    """A row per file: device, file_no, file, detections (array of label and score), bench (structure of times)."""
    files = with_files(lines).where(_is(FILE_LINE)).select("device", "file_no", "file")
    found = detections(lines, threshold, k).groupBy("device", "file_no", "file").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("d"))
    keys = ["device", "file_no", "file"]
    timed = timings(lines).select(*keys, F.struct(*TIMES).alias("bench"))
    done = files.join(found, keys, "left").join(timed, keys, "left")
    return done.select(*keys, F.coalesce(F.transform("d", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))), F.array().cast("array<struct<label:string,score:double>>")).alias("detections"), "bench")


def averages(each: DataFrame, by: str = "device") -> DataFrame:
    """Whole milliseconds per file: sums divided without remainder, and the number of files."""
    return each.groupBy(by).agg(*((F.floor(F.sum(t) / F.count("*"))).cast("long").alias(f"avg_{t}") for t in TIMES), F.count("*").alias("files"))


def real_time(rows: DataFrame, total: str = "avg_total_ms", chunk_seconds: float = 3.0) -> DataFrame:
    """`rows` with rtf (time taken over time recorded) and speedup (the inverse); 0 where the divisor is 0."""
    span = F.lit(chunk_seconds * 1000)
    return rows.withColumns({"rtf": F.coalesce(F.try_divide(F.col(total), span), F.lit(0.0)), "speedup": F.coalesce(F.try_divide(span, F.col(total)), F.lit(0.0))})


def board_rows(each: DataFrame) -> DataFrame:
    """file, top_label, top_score (text with four places) of results; empty where nothing was found."""
    best = F.get("detections", F.lit(0))
    return each.select("file", F.coalesce(best["label"], F.lit("")).alias("top_label"), F.coalesce(F.format_string("%.4f", best["score"]), F.lit("")).alias("top_score"))


def escaped(label: Column) -> Column:
    """A label as the inside of a C string."""
    return F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


# The defines of a configuration header. Those of the board are only set where they are not yet.
BOARD_DEFINES = {
    "NUCLEO_N6_CONFIG": 0, "USE_MCU_DCACHE": 1, "USE_MCU_ICACHE": 1, "USE_EXTERNAL_MEMORY_DEVICES": 1, "USE_UART_BAUDRATE": 921600, "USE_USB_PACKET_SIZE": 512, "USE_OVERDRIVE": 0,
}
FRONTEND_DEFINES = {"APP_FRONTEND_HYBRID": 0, "APP_FRONTEND_RAW": 1, "APP_FRONTEND_PRECOMPUTED": 2}
RUN_DEFINES = {"APP_AUDIO_DIR": '"audio"', "APP_RESULTS_FILE": '"results.txt"', "APP_TOP_K": "5", "APP_SCORE_THRESHOLD": "0.01f"}


def config_header(config: Column, classes: Column) -> Column:
    """A C header of a model's settings (sample_rate, chunk_duration, fft_length, hop_length, spec_width, num_mels, audio_frontend)."""
    chunk = config["chunk_duration"]
    whole = lambda c: c.cast("long").cast("string")
    front = F.when(config["audio_frontend"].isin("raw", "tf"), "APP_FRONTEND_RAW").when(config["audio_frontend"].isin("librosa", "precomputed"), "APP_FRONTEND_PRECOMPUTED").otherwise("APP_FRONTEND_HYBRID")
    values = {
        "APP_SAMPLE_RATE": whole(config["sample_rate"]),
        "APP_CHUNK_DURATION": F.when(chunk == F.floor(chunk), whole(chunk)).otherwise(chunk.cast("string")),
        "APP_CHUNK_SAMPLES": whole(config["sample_rate"] * chunk),
        "APP_FFT_LENGTH": whole(config["fft_length"]),
        "APP_FFT_BINS": F.lit("(APP_FFT_LENGTH / 2 + 1)"),
        "APP_HOP_LENGTH": whole(F.coalesce(config["hop_length"].cast("long"), F.floor(config["fft_length"] / 2) + 2)),
        "APP_SPEC_WIDTH": whole(config["spec_width"]),
        "APP_NUM_MELS": whole(config["num_mels"]),
        "APP_NUM_CLASSES": whole(classes),
        **{k: F.lit(str(v)) for k, v in FRONTEND_DEFINES.items()},
        "APP_AUDIO_FRONTEND": front,
        **{k: F.lit(v) for k, v in RUN_DEFINES.items()},
    }
    board = "".join(f"#ifndef {k}\n#define {k} {v}\n#endif\n" for k, v in BOARD_DEFINES.items())
    return F.concat(F.lit("#ifndef APP_CONFIG_H\n#define APP_CONFIG_H\n" + board), *(x for k, v in values.items() for x in (F.lit(f"#define {k} "), v, F.lit("\n"))), F.lit("#endif\n"))


def labels_header(labels: Column) -> Column:
    """A C header of an array of labels."""
    names = F.array_join(F.transform(labels, lambda x: F.concat(F.lit('    "'), escaped(x), F.lit('",\n'))), "")
    return F.concat(F.lit("#ifndef APP_LABELS_H\n#define APP_LABELS_H\n#define APP_NUM_CLASSES_ACTUAL "), F.size(labels).cast("string"), F.lit("\nstatic const char * const APP_LABELS[] = {\n"), names, F.lit("};\n#endif\n"))
