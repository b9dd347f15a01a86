"""Sinks, each written and read back, and scans that count errors instead of raising them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane import config
from corvane.operators import drawings, ranking, reports
from corvane.plans.evaluation import files
from corvane.plans.facts import SCORED, scored
from corvane.plans.metrics import AP, MICRO, STEPS
from corvane.plans.models import SERIES, series
from corvane.plans.registry import query, table
from corvane.plans.signals import LONG, SIGNALS, signals
from corvane.plans.telemetry import _scratch
from corvane.sources import archives, recordings, texts, wav


@query("SELECT DISTINCT trim(source) AS species FROM documents")
def s9_species_sink(spark, sf_dir):
    """A list of names, one a line."""
    folder = _scratch(spark)
    texts.save_lines(table(spark, sf_dir, "documents").select("source").distinct(), "source", f"{folder}/species.txt")
    return texts.open_species(spark, f"{folder}/species.txt")


@query("""SELECT s_suppkey AS id, (16000 + s_suppkey)::INT AS sample_rate, 'raw' AS audio_frontend, 256 AS spec_width FROM supplier""")
def s10_config_files(spark, sf_dir):
    """JSON documents over several lines, divided by form feeds; what they lack has defaults."""
    folder = _scratch(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string('{\n "sample_rate": %d,\n "audio_frontend": "tf",\n "id": %d}', F.col("s_suppkey") + 16_000, F.col("s_suppkey")).alias("value"))
    rows.select("value").write.option("lineSep", texts.DOCUMENT_END).text(f"{folder}/configs")
    found = texts.load_config(spark, f"{folder}/configs", texts.DOCUMENT_END).select(F.get_json_object("value", "$.id").cast("long").alias("id"), config.parsed(F.col("value")).alias("c"))
    return found.select("id", "c.sample_rate", "c.audio_frontend", "c.spec_width")


@query(f"WITH {SERIES} SELECT run, step::INT AS step, value FROM ser")
def s17_history_sink(spark, sf_dir):
    """Training histories appended in two turns, with a header."""
    folder = _scratch(spark)
    rows = series(spark, sf_dir)
    for turn in ("step < 10", "step >= 10"):
        texts.save_csv(rows.where(turn), f"{folder}/history", append=True)
    return texts.load_history(spark, f"{folder}/history").select(F.col("run").cast("long"), F.col("step").cast("int"), F.col("value").cast("double"))


@query(f"WITH {SCORED} SELECT file, class, printf('%.4f', floor(s * 10000) / 10000) AS score FROM scored")
def s18_device_table_sink(spark, sf_dir):
    """Scores separated by tabs, cut off after four places."""
    folder = _scratch(spark)
    rows = scored(spark, sf_dir).select("file", "class", F.format_string("%.4f", F.floor(F.col("s") * 10_000) / 10_000).alias("score"))
    texts.save_csv(rows, f"{folder}/scores", "\t")
    return spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/scores").select(F.col("file").cast("long"), F.col("class").cast("int"), "score")


def polylines_sql(dots: str) -> str:
    """Lines of dots (series, px, py), as one picture."""
    return f"""cols AS (SELECT series, px, min(py) AS top, max(py) AS low FROM ({dots}) GROUP BY ALL), lns AS (SELECT series, '<polyline fill="none" stroke="black" points="' || string_agg(px || ',' || top || ' ' || px || ',' || low, ' ' ORDER BY px) || '"/>' AS line FROM cols GROUP BY series),
    curve AS (SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="300">' || string_agg(line, '' ORDER BY series) || '</svg>' AS svg FROM lns)"""


# Ten classes: cells of 60 pixels.
CELLS = """cel AS (SELECT "true" AS t, pred AS p, count(*) AS n FROM (SELECT file, arg_max(class, (y, -class)) AS "true", max(y) AS known, arg_max(class, (s, -class)) AS pred FROM scored GROUP BY file) WHERE known > 0 GROUP BY ALL),
    heat AS (SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="600" height="600">' || string_agg('<rect x="' || p * 60 || '" y="' || t * 60 || '" width="60" height="60" fill="navy" fill-opacity="' || printf('%.3f', floor(1000 * n / (SELECT max(n) FROM cel)) / 1000) || '"/>', '' ORDER BY t, p) || '</svg>' AS svg FROM cel)"""


@query(f"WITH {SCORED}, {CELLS} SELECT svg FROM heat")
def s16_confusion_drawing(spark, sf_dir):
    """The heatmap of the confusion of top classes."""
    return drawings.heatmap(ranking.confusion(scored(spark, sf_dir), None), 10)


@query(f"""WITH {SCORED}, {MICRO.format(fact="scored")}, p AS (SELECT (cn - ctp) / (n_all - tp_all) AS x, (tp_all - ctp) / tp_all AS y FROM r), {polylines_sql("SELECT 0 AS series, floor(least(greatest(x, 0), 1) * 399)::INT AS px, (299 - floor(least(greatest(y, 0), 1) * 299))::INT AS py FROM p")}
    SELECT svg FROM curve""")
def s16_det_drawing(spark, sf_dir):
    """The curve of false alarms and misses."""
    return drawings.curve(ranking.det_curve(scored(spark, sf_dir)), "far", "frr", bounds=(0, 1, 0, 1))


@query(f"""WITH {SERIES}, b AS (SELECT min(step)::DOUBLE AS x0, max(step)::DOUBLE AS x1, min(value)::DOUBLE AS y0, max(value)::DOUBLE AS y1 FROM ser),
    {polylines_sql("SELECT run % 4 AS series, CASE WHEN x1 > x0 THEN floor(least(greatest((step - x0) / (x1 - x0), 0), 1) * 399) ELSE 0 END::INT AS px, (299 - CASE WHEN y1 > y0 THEN floor(least(greatest((value - y0) / (y1 - y0), 0), 1) * 299) ELSE 0 END)::INT AS py FROM ser, b")}
    SELECT svg FROM curve""")
def s16_history_drawing(spark, sf_dir):
    """Training histories of four groups of runs: the span of values at each step."""
    return drawings.curve(series(spark, sf_dir).withColumn("group", F.col("run") % 4), "step", "value", "group")


@query(f"""WITH {SCORED}, {CELLS}, c AS (SELECT sum(CASE WHEN s >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) AS pp, sum(y) AS p FROM scored), q AS (SELECT tp / (pp + 1e-12) AS pr, tp / (p + 1e-12) AS re FROM c),
    {STEPS.format(fact="scored")}, k AS (SELECT class, {AP} AS ap, sum(tp)::BIGINT AS np, sum(n)::BIGINT AS nt FROM r GROUP BY class),
    tab AS (SELECT string_agg('<tr><td>' || class || '</td><td>' || printf('%.6f', ap) || '</td><td>' || np || '</td><td>' || nt || '</td></tr>', '' ORDER BY class) AS body FROM k)
    SELECT '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Evaluation</title></head><body><h1>Evaluation</h1><h2>Metrics</h2><table><tr><th>precision</th><th>recall</th><th>f1</th></tr><tr><td>' || printf('%.6f', pr) || '</td><td>' || printf('%.6f', re) || '</td><td>'
        || printf('%.6f', CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) || '</td></tr></table><h2>Classes</h2><table><tr><th>class</th><th>ap</th><th>n_positive</th><th>n_total</th></tr>' || body || '</table><h2>Confusion</h2><div>' || svg || '</div></body></html>' AS page FROM q, tab, heat""")
def s15_html_report(spark, sf_dir):
    """A page with the metrics, the classes and the drawn confusion of an evaluation."""
    rows = scored(spark, sf_dir)
    tables = {"Metrics": ranking.micro_scores(rows), "Classes": ranking.average_precision(rows, ["class"]).orderBy("class")}
    page = reports.html_report("Evaluation", tables, {"Confusion": drawings.heatmap(ranking.confusion(rows, None), 10)})
    return spark.createDataFrame([(page,)], "page string")


@query("""WITH k AS (SELECT vec_id, embedding FROM embeddings ORDER BY (((vec_id + 1) * 1103515245 + 42 * 12345) % 2147483647) * 48271 % 2147483647, vec_id LIMIT 25)
    SELECT vec_id, i::INT AS i, embedding[i + 1]::DOUBLE AS v FROM k, (SELECT unnest(range(0, 64)) AS i) q""")
def s21_validation_sample(spark, sf_dir):
    """25 rows in a seeded order, a limit that is the feature, written as an NPZ archive and read back."""
    folder = _scratch(spark)
    spark.dataSource.register(archives.NpzArchives)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    texts.validation_sample(rows, "vec_id", 25).coalesce(1).write.format("npz").mode("append").save(folder)
    return archives.load_npz(spark, folder, "vec_id long, v array<double>").select("vec_id", F.posexplode("v").alias("i", "v"))


@query("""SELECT vec_id AS id, i::INT AS i, (('0x' || substr(md5('42:calibration:' || i || ':' || vec_id), 1, 8))::BIGINT + 0.5) / 4294967296 AS v FROM embeddings, (SELECT unnest(range(0, 4)) AS i) q""")
def s22_random_calibration(spark, sf_dir):
    """Uniform numbers to calibrate with, as many rows as there are vectors."""
    rows = texts.noise_rows(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", 4)
    return rows.select("id", F.posexplode("values").alias("i", "v"))


# A file's window of 4 ms at 8 kHz begins where a digest of its name draws.
WINDOW = """d AS (SELECT file, label, x, floor((('0x' || substr(md5('42:window:' || file || '.wav'), 1, 8))::BIGINT + 0.5) / 4294967296 * 0.004 * 8000)::INT AS a FROM sig)"""


@query(f"WITH {SIGNALS}, {WINDOW} SELECT file, (i - 1)::INT AS i, round_even(greatest(-1, least(1, x[a + i])) * 32767, 0) / 32768 AS v FROM d, (SELECT unnest(range(1, 33)) AS i) q")
def s3_windows(spark, sf_dir):
    """Signals as WAV files, a file a row, and a drawn window of each: read by ranges."""
    folder = _scratch(spark)
    spark.dataSource.register(archives.WavFiles)
    rows = signals(spark, sf_dir).select(F.concat("label", F.lit("/"), "file", F.lit(".wav")).alias("path"), F.lit(8_000).alias("sample_rate"), F.col("x").alias("samples"))
    rows.write.format("wavfiles").mode("append").save(folder)
    found = recordings.load(spark, folder, seconds=0.004, offset="random", normalize=False)
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file"), F.posexplode("samples").alias("i", "v"))


@query(f"WITH {LONG}, p AS (SELECT file, i // 16 AS w, max(abs(round_even(greatest(-1, least(1, v)) * 32767, 0))) AS top, sum(round_even(greatest(-1, least(1, v)) * 32767, 0)) AS total FROM smp WHERE i >= 32 GROUP BY ALL) SELECT file, round(w * 0.002, 6) AS start, round(total / top, 6) AS total, 16::BIGINT AS n FROM p")
def s4_later_windows(spark, sf_dir):
    """All windows of 2 ms from 4 ms on: the condition is taken over by the source, which reads no others."""
    folder = _scratch(spark)
    spark.dataSource.register(archives.WavFiles)
    rows = signals(spark, sf_dir).select(F.concat("file", F.lit(".wav")).alias("path"), F.lit(8_000).alias("sample_rate"), F.col("x").alias("samples"))
    rows.write.format("wavfiles").mode("append").save(folder)
    found = recordings.load(spark, folder, seconds=0.002, offset="all").where("start >= 0.004")
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file"), F.round("start", 6).alias("start"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("samples").cast("long").alias("n"))


@query("SELECT count(*) FILTER (vec_id % 7 <> 0) AS processed, count(*) AS total, count(*) FILTER (vec_id % 7 = 0) AS errors FROM embeddings")
def r6_counted_errors(spark, sf_dir):
    """A scan over files of which every seventh is broken: errors are counted, not raised."""
    broken = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long") % 7 == 0
    found = wav.signals(files(spark, sf_dir).withColumn("content", F.when(broken, F.encode(F.lit("RIFF?"), "UTF-8")).otherwise(F.col("content"))))
    return found.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("processed"), F.count("*").alias("total"), F.count("error").alias("errors"))
