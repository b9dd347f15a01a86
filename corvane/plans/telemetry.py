"""Device telemetry, settings as JSON, and the streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import config, session
from corvane.operators import epochs, passes, telemetry
from corvane.operators.numbering import numbered
from corvane.plans.registry import query, table
from corvane.streaming import device

# Events as what devices print: each event is a file with its detections and timing.
EVENTS = """ev AS (SELECT 'd' || user_id % 7 AS device, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS no, 'rec_' || event_id || '.wav' AS file, event_type AS label, floor(value * 10)::INT % 1000 AS tenths,
    (event_id % 40)::INT AS r, (event_id % 25)::INT AS s, (event_id % 9)::INT AS u FROM events)"""


def lines(spark, sf_dir):
    """Four lines an event: the file, its timing, two detections."""
    hours = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    rows = numbered(table(spark, sf_dir, "events").withColumn("device", F.col("user_id") % 7), ["device"], [hours, F.col("ts"), F.col("event_id")], "no")
    tenths = F.floor(F.col("value") * 10).cast("int") % 1000
    events = rows.select(
        F.concat(F.lit("d"), "device").alias("device"), F.col("no").cast("int").alias("no"), "event_id", "event_type", tenths.alias("tenths"), (F.col("event_id") % 40).alias("r"), (F.col("event_id") % 25).alias("s"), (F.col("event_id") % 9).alias("u")
    )
    percent = lambda t: F.concat(F.floor(t / 10), F.lit("."), t % 10)
    texts = F.array(
        F.concat(F.lit("["), "no", F.lit("/9999] rec_"), "event_id", F.lit(".wav")),
        F.format_string("  [BENCH] read=%dms stft=%dms npu=%dms total=%dms", "r", "s", "u", F.col("r") + F.col("s") + F.col("u")),
        F.concat(F.lit("    [1] "), "event_type", F.lit(": "), percent(F.col("tenths")), F.lit("%")),
        F.concat(F.lit("    [2] other kind: "), percent(1000 - F.col("tenths")), F.lit("%")),
    )
    return events.select("device", "no", F.posexplode(texts).alias("i", "line")).select("device", (F.col("no") * 4 + F.col("i")).cast("long").alias("line_no"), "line")


DETECTED = "det AS (SELECT device, no, file, 1 AS line, label, tenths FROM ev UNION ALL SELECT device, no, file, 2, 'other kind', 1000 - tenths FROM ev), hit AS (SELECT *, row_number() OVER (PARTITION BY device, no ORDER BY line) AS rank FROM det WHERE tenths / 10 / 100 >= 0.3)"


@query(f"WITH {EVENTS}, {DETECTED} SELECT device, no::INT AS file_no, file, label, round(tenths / 1000, 4) AS score, rank::INT AS rank FROM hit WHERE rank <= 2")
def t1_parsed_detections(spark, sf_dir):
    return telemetry.detections(lines(spark, sf_dir), 0.3, 2).withColumn("score", F.round("score", 4))


@query(f"WITH {EVENTS}, {DETECTED} SELECT device, no::INT AS file_no, file, label, round(tenths / 1000, 4) AS score, rank::INT AS rank FROM hit WHERE rank <= 1")
def f8_threshold_and_top_k(spark, sf_dir):
    return telemetry.detections(lines(spark, sf_dir), 0.3, 1).withColumn("score", F.round("score", 4))


@query(f"WITH {EVENTS} SELECT device, (no * 4 + i)::BIGINT AS line_no, file, no::INT AS file_no FROM ev, (SELECT unnest(range(0, 4)) AS i) k")
def j5_enclosing_file(spark, sf_dir):
    """The last file line before each line: a backward as-of join."""
    return telemetry.with_files(lines(spark, sf_dir)).select("device", "line_no", "file", "file_no")


@query(f"WITH {EVENTS} SELECT device, no::INT AS file_no, file, r AS read_ms, s AS stft_ms, u AS npu_ms, r + s + u AS total_ms FROM ev")
def t1_parsed_timings(spark, sf_dir):
    return telemetry.timings(lines(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT device, sum(r)::BIGINT // count(*) AS avg_read_ms, sum(s)::BIGINT // count(*) AS avg_stft_ms, sum(u)::BIGINT // count(*) AS avg_npu_ms, sum(r + s + u)::BIGINT // count(*) AS avg_total_ms, count(*) AS files FROM ev GROUP BY device")
def a13_device_averages(spark, sf_dir):
    return telemetry.averages(telemetry.timings(lines(spark, sf_dir)))


@query(f"WITH {EVENTS}, a AS (SELECT device, sum(r + s + u)::BIGINT // count(*) AS t FROM ev GROUP BY device) SELECT device, round(t / 3000, 6) AS rtf, round(3000 / t, 6) AS speedup FROM a")
def a14_real_time_factor(spark, sf_dir):
    done = telemetry.real_time(telemetry.averages(telemetry.timings(lines(spark, sf_dir))))
    return done.select("device", F.round("rtf", 6).alias("rtf"), F.round("speedup", 6).alias("speedup"))


@query(f"""WITH {EVENTS} SELECT device, count(*)::INT AS processed, (count(*) + 2)::INT AS total, 2 AS errors, (sum(r)::BIGINT // count(*))::INT AS avg_read_ms, (sum(s)::BIGINT // count(*))::INT AS avg_stft_ms,
    (sum(u)::BIGINT // count(*))::INT AS avg_npu_ms, (sum(r + s + u)::BIGINT // count(*))::INT AS avg_total_ms FROM ev GROUP BY device""")
def t1_parsed_totals(spark, sf_dir):
    """The totals each device's run ends with, behind all its lines."""
    rows = lines(spark, sf_dir)
    each = telemetry.averages(telemetry.timings(rows))
    average = F.format_string("(avg read=%dms stft=%dms npu=%dms total=%dms)", *(f"avg_{t}" for t in telemetry.TIMES))
    last = F.array(F.lit(telemetry.MARKER), F.format_string("Processed: %d / %d files (2 errors)", "files", F.col("files") + 2), F.concat(F.lit("Benchmark: read=1ms stft=1ms npu=1ms total=3ms "), average))
    ends = each.select("device", F.posexplode(last).alias("i", "line")).select("device", (F.lit(1 << 40) + F.col("i")).alias("line_no"), "line")
    return telemetry.totals(rows.select("device", "line_no", "line").unionByName(ends))


@query(f"WITH {EVENTS}, {DETECTED}, f AS (SELECT * FROM hit WHERE rank = 1) SELECT ev.file, coalesce(f.label, '') AS top_label, coalesce(printf('%.4f', f.tenths / 1000), '') AS top_score FROM ev LEFT JOIN f USING (device, no)")
def s20_board_table(spark, sf_dir):
    return telemetry.board_rows(telemetry.results(lines(spark, sf_dir), 0.3, 2))


SETTINGS = """st AS (SELECT source, count(DISTINCT lang) AS n, CASE WHEN count(*) % 2 = 0 THEN 3.0 ELSE 2.5 END::DOUBLE AS chunk, CASE WHEN count(*) % 3 = 0 THEN 'raw' WHEN count(*) % 3 = 1 THEN 'librosa' ELSE 'hybrid' END AS front,
    string_agg(DISTINCT '    "' || lang || '\\"x\\\\y",' || chr(10), '' ORDER BY '    "' || lang || '\\"x\\\\y",' || chr(10)) AS names FROM documents GROUP BY source)"""


@query(f"""WITH {SETTINGS.replace(chr(92) * 4, chr(92) * 4)} SELECT source, array_to_string([
    '#ifndef APP_CONFIG_H', '#define APP_CONFIG_H',
    '#ifndef NUCLEO_N6_CONFIG', '#define NUCLEO_N6_CONFIG 0', '#endif', '#ifndef USE_MCU_DCACHE', '#define USE_MCU_DCACHE 1', '#endif', '#ifndef USE_MCU_ICACHE', '#define USE_MCU_ICACHE 1', '#endif',
    '#ifndef USE_EXTERNAL_MEMORY_DEVICES', '#define USE_EXTERNAL_MEMORY_DEVICES 1', '#endif', '#ifndef USE_UART_BAUDRATE', '#define USE_UART_BAUDRATE 921600', '#endif',
    '#ifndef USE_USB_PACKET_SIZE', '#define USE_USB_PACKET_SIZE 512', '#endif', '#ifndef USE_OVERDRIVE', '#define USE_OVERDRIVE 0', '#endif',
    '#define APP_SAMPLE_RATE 24000', '#define APP_CHUNK_DURATION ' || CASE WHEN chunk = 3 THEN '3' ELSE '2.5' END, '#define APP_CHUNK_SAMPLES ' || CASE WHEN chunk = 3 THEN 72000 ELSE 60000 END,
    '#define APP_FFT_LENGTH 512', '#define APP_FFT_BINS (APP_FFT_LENGTH / 2 + 1)', '#define APP_HOP_LENGTH 258', '#define APP_SPEC_WIDTH 256', '#define APP_NUM_MELS 64', '#define APP_NUM_CLASSES ' || n,
    '#define APP_FRONTEND_HYBRID 0', '#define APP_FRONTEND_RAW 1', '#define APP_FRONTEND_PRECOMPUTED 2', '#define APP_AUDIO_FRONTEND APP_FRONTEND_' || CASE front WHEN 'raw' THEN 'RAW' WHEN 'librosa' THEN 'PRECOMPUTED' ELSE 'HYBRID' END,
    '#define APP_AUDIO_DIR "audio"', '#define APP_RESULTS_FILE "results.txt"', '#define APP_TOP_K 5', '#define APP_SCORE_THRESHOLD 0.01f', '#endif', ''], chr(10)) AS config,
    '#ifndef APP_LABELS_H' || chr(10) || '#define APP_LABELS_H' || chr(10) || '#define APP_NUM_CLASSES_ACTUAL ' || n || chr(10) || 'static const char * const APP_LABELS[] = {{' || chr(10) || names || '}};' || chr(10) || '#endif' || chr(10) AS labels FROM st""")
def t2_header_text(spark, sf_dir):
    """Headers of settings and of labels, one pair per source; labels have marks to escape."""
    names = F.array_sort(F.collect_set(F.concat("lang", F.lit('"x\\y'))))
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(names.alias("labels"), F.count("*").alias("n"))
    front = F.when(F.col("n") % 3 == 0, "raw").when(F.col("n") % 3 == 1, "librosa").otherwise("hybrid")
    chunk = F.when(F.col("n") % 2 == 0, 3.0).otherwise(2.5)
    settings = F.struct(
        F.lit(24_000).alias("sample_rate"), chunk.alias("chunk_duration"), F.lit(512).alias("fft_length"), F.lit(None).cast("int").alias("hop_length"), F.lit(256).alias("spec_width"), F.lit(64).alias("num_mels"), front.alias("audio_frontend")
    )
    return rows.select("source", telemetry.config_header(settings, F.size("labels")).alias("config"), telemetry.labels_header(F.col("labels")).alias("labels"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::INT ELSE 24000 END AS sample_rate, 3.0::DOUBLE AS chunk_duration, CASE doc_id % 3 WHEN 0 THEN 'librosa' WHEN 1 THEN 'raw' ELSE 'hybrid' END AS audio_frontend, 'pwl' AS mag_scale, 281 AS hop_length, 20 AS n_mfcc, 256 AS embeddings_size, true AS use_se, 0.5::DOUBLE AS dropout_rate, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS depth_multiplier, 0 AS num_classes FROM documents""")
def t3_model_config(spark, sf_dir):
    """Settings as JSON and back: unknown keys go, missing ones have defaults, aliases are resolved."""
    name = F.get(F.array(*map(F.lit, ["precomputed", "tf"])), (F.col("doc_id") % 3).cast("int"))
    text = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("sample_rate"), name.alias("audio_frontend"), F.when(F.col("doc_id") % 2 == 0, 2).alias("depth_multiplier"), F.col("source").alias("no_such_key")))
    done = table(spark, sf_dir, "documents").select("doc_id", config.parsed(text).alias("c"))
    return done.select("doc_id", *(f"c.{k}" for k in ("sample_rate", "chunk_duration", "audio_frontend", "mag_scale", "hop_length", "n_mfcc", "embeddings_size", "use_se", "dropout_rate", "depth_multiplier", "num_classes")))


@query(f"WITH {EVENTS}, {DETECTED} SELECT device, no::INT AS file_no, file, rank::INT AS rank, label, round(tenths / 1000, 4) AS score FROM hit WHERE rank <= 2")
def r2_streamed_detections(spark, sf_dir):
    """All devices' lines through the stateful stream."""
    folder = _scratch(spark)
    device.write_lines(lines(spark, sf_dir), f"{folder}/lines")
    found = device.detections(device.read_lines(spark, f"{folder}/lines"), 0.3, 2)
    return device.drained(found, folder).withColumn("score", F.round("score", 4))


# A line every hundredth of a second, a run of at most four seconds; some devices end with the marker before that.
MARKS = {"d0": 200, "d1": 402, "d2": 200, "d3": 500}
CAPTURED = f"""tl AS (SELECT device, no * 4 + i AS line_no FROM ev, (SELECT unnest(range(0, 4)) AS i) k), mk AS (SELECT device, line_no AS mark FROM tl JOIN (VALUES {", ".join(map(str, MARKS.items()))}) m(device, mark) USING (device) WHERE line_no = mark AND line_no < 404)
    SELECT device, line_no FROM tl LEFT JOIN mk USING (device) WHERE CASE WHEN mark IS NULL THEN line_no < 404 ELSE line_no <= mark + 5 END"""


def timed_lines(spark, sf_dir):
    place = F.col("line_no")
    mark = F.lit(False)
    for name, at in MARKS.items():
        mark = mark | ((F.col("device") == name) & (place == at))
    return lines(spark, sf_dir).select("device", "line_no", (place / 100).alias("at"), F.when(mark, F.concat(F.lit("  "), F.lit(telemetry.MARKER))).otherwise(F.col("line")).alias("line"))


@query(f"WITH {EVENTS}, {CAPTURED}")
def s19_serial_capture(spark, sf_dir):
    """What belongs to each device's run: until the deadline, or the marker and five lines more."""
    return telemetry.captured(timed_lines(spark, sf_dir), 4.0).select("device", "line_no")


@query(f"WITH {EVENTS}, {CAPTURED}")
def r1_serial_capture(spark, sf_dir):
    """The same as a stream, stopped after half the lines and started again on its checkpoint."""
    folder = _scratch(spark)
    rows = device.staged_lines(timed_lines(spark, sf_dir))
    for those in ("line_no < 150", "line_no >= 150"):
        device.write_staged(rows.where(those), f"{folder}/lines")
        stream = device.captured(device.read_lines(spark, f"{folder}/lines", schema=device.TIMED_LINES), 4.0)
        with device.stateful(spark):
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/captured").awaitTermination()
    return spark.read.schema(device.TIMED_LINES).parquet(f"{folder}/captured").select("device", "line_no")


@query(f"WITH {EVENTS}, tl AS (SELECT device, no * 4 + i AS line_no FROM ev, (SELECT unnest(range(0, 4)) AS i) k) SELECT device, line_no FROM tl WHERE line_no <= CASE device WHEN 'd0' THEN 203 WHEN 'd1' THEN 407 WHEN 'd2' THEN 200 ELSE 403 END")
def s19_capture_gaps(spark, sf_dir):
    """Runs whose marker is followed by a silence: d0 after three more lines, d2 at once."""
    late = F.when(F.col("device") == "d0", F.col("line_no") > 203).when(F.col("device") == "d2", F.col("line_no") > 200).otherwise(False)
    rows = timed_lines(spark, sf_dir).withColumn("at", F.col("at") + F.when(late, 1.5).otherwise(0.0))
    return telemetry.captured(rows, 4.0).select("device", "line_no")


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL '12 hours', ts - INTERVAL (k * 12) HOURS) AS start, value, ts FROM events, (SELECT unnest(range(0, 2)) AS k) q)
    SELECT event_type, start::TIMESTAMP AS start, round(avg(value), 6) AS mean, max(value) AS best FROM w WHERE ts >= start AND ts < start + INTERVAL 24 HOURS GROUP BY ALL""")
def r1_streamed_windows(spark, sf_dir):
    """Overlapping windows over a stream of events, a day wide every half day, until the stream ends."""
    events = table(spark, sf_dir, "events")
    folder = _scratch(spark)
    events.select("ts", "event_type", "value").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{folder}/events")
    done = device.windowed_scores(stream, "ts", "value", "event_type", "24 hours", "12 hours", "1 day")
    found = device.updated(done, folder, ["event_type", "start", "end"])
    return found.select("event_type", "start", F.round("mean", 6).alias("mean"), "best")


# Hill climbing by a recursive query: values as throughput, memory free of 0 (not known) to 16 by turns.
CLIMB = """WITH RECURSIVE ser AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value FROM events), x AS (SELECT run, step, value, step % 5 * 4 AS free FROM ser),
    r AS (SELECT DISTINCT run, -1::BIGINT AS step, 128::BIGINT AS n, 1 AS way, 64::BIGINT AS "by", NULL::DOUBLE AS last FROM ser UNION ALL
        SELECT r.run, x.step, CASE WHEN free > 0 AND free < 8 THEN greatest(128, floor(n * 0.8)) WHEN last IS NULL THEN least(4096, n + "by")
                WHEN value >= last * 1.01 THEN CASE WHEN way >= 0 THEN least(4096, n + "by") ELSE greatest(128, n - "by") END
                WHEN way >= 0 THEN greatest(128, n - greatest(16, "by" // 2)) ELSE least(4096, n + greatest(16, "by" // 2)) END::BIGINT,
            CASE WHEN free > 0 AND free < 8 THEN -1 WHEN last IS NULL THEN 1 WHEN value >= last * 1.01 THEN way WHEN way >= 0 THEN -1 ELSE 1 END,
            CASE WHEN (free > 0 AND free < 8) OR (last IS NOT NULL AND value < last * 1.01) THEN greatest(16, "by" // 2) ELSE "by" END, value
        FROM r JOIN x ON x.run = r.run AND x.step = r.step + 1)
    SELECT run AS user_id, arg_max(n, step)::INT AS in_flight FROM r GROUP BY run"""


@query(CLIMB)
def r5_backpressure(spark, sf_dir):
    """Items in flight after each user's series of throughputs."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1  # a count along the rows: none are held
    turns = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("throughput"), (step % 5 * 4).alias("memory_free"))
    return device.climbed(turns, "user_id", ["ts", "event_id"])


@query()
def r3_reservoir_order(spark, sf_dir):
    """The order in which eight loaders give the documents in an epoch, through a buffer of 128 drained to 64."""
    return epochs.epoch(table(spark, sf_dir, "documents").select("doc_id"), 3, 128, 64, key="doc_id").select("doc_id", "shard", "place")


MIX = "(((({x} + 1) * 1103515245 + {k} * 12345) % 2147483647) * ((({x} + 1) * 1103515245 + {k} * 12345) % 2147483647) + {k}) % 2147483647 * 48271 % 2147483647"
PASS = f"""num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), ab AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM num), bb AS (SELECT *, (n + a - 1) // a AS b FROM ab),
    r0 AS (SELECT *, i // b AS l, i % b AS r FROM bb), r1 AS (SELECT * REPLACE ((l + {MIX.format(x="r", k=54)}) % a AS l) FROM r0), r2 AS (SELECT * REPLACE ((r + {MIX.format(x="l", k=55)}) % b AS r) FROM r1),
    r3 AS (SELECT * REPLACE ((l + {MIX.format(x="r", k=56)}) % a AS l) FROM r2), r4 AS (SELECT * REPLACE ((r + {MIX.format(x="l", k=57)}) % b AS r) FROM r3)"""


@query(f"WITH {PASS}, s AS (SELECT doc_id, l * b + r AS slot, (a * b + (n + 299) // 300 - 1) // ((n + 299) // 300) AS size FROM r4) SELECT doc_id, slot, (slot // size)::INT AS shard FROM s")
def r3_pass_order(spark, sf_dir):
    """The slots of the documents in the fourth pass, given through a buffer of 128 drained to 64, shards of about 300."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    numbers = numbered(rows, [], [F.col("doc_id")], "number").withColumn("number", F.col("number") - 1)
    return passes.in_order(numbers, rows.count(), 3, 128, 64, shard_rows=300).select("doc_id", "slot", "shard")


@query("""SELECT s_suppkey AS id, 'models/' || s_suppkey AS model_path, CASE WHEN s_suppkey % 2 = 0 THEN 'port ' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'from file' ELSE '/dev/ttyACM0' END AS port, CASE WHEN s_suppkey % 3 = 0 THEN 9600 ELSE 115200 END AS baud,
    CASE WHEN s_suppkey % 5 = 0 THEN 7.5 WHEN s_suppkey % 3 = 0 THEN 9 ELSE 120 END::DOUBLE AS timeout, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 5 END AS top_k, 0.01::DOUBLE AS score_threshold FROM supplier""")
def t5_deploy_settings(spark, sf_dir):
    """Settings in layers, a board a supplier: given ones, the environment, a file's, defaults; null and empty values do not count."""
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.lit('{"port": "from file", "timeout": 9, "top_k": 3, "baud": 9600}'))
    of_file = {f: F.get_json_object(text, f"$.{f}") for f in ("port", "timeout", "top_k", "baud")}
    given = {"model_path": F.concat(F.lit("models/"), key), "port": F.when(key % 2 == 0, F.concat(F.lit("port "), key)).otherwise("")}
    found = config.layered_columns(given, {"timeout": F.when(key % 5 == 0, "7.5")}, of_file)
    return table(spark, sf_dir, "supplier").select(key.alias("id"), found.alias("c")).select("id", "c.*")


def _scratch(spark) -> str:
    """A folder of its own where all executors can write."""
    return f"{session.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
