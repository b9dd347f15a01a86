"""Recordings to samples and to metrics, and WAV files as bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import spectral
from corvane.functions.frontends import Feature, features
from corvane.operators import catalog, evaluation, ranking, scoring
from corvane.operators.numbering import numbered
from corvane.plans.metrics import AP, STEPS
from corvane.plans.registry import query, table
from corvane.plans.signals import GREEDY, LONG, SIGNALS, bank_sql, gain_sql, signals, smoothing_sql, spectra_sql
from corvane.sources import wav


def files(spark, sf_dir):
    """Signals as WAV files of 16 bits at 8 kHz."""
    rows = signals(spark, sf_dir).select(F.concat(F.lit("set/"), "label", F.lit("/"), "file", F.lit(".wav")).alias("path"), F.lit(8_000).alias("sample_rate"), F.col("x").alias("samples"))
    return wav.as_files(rows)


@query(f"WITH {LONG} SELECT 'set/' || label || '/' || file || '.wav' AS path, i::INT AS i, round_even(greatest(-1, least(1, v)) * 32767, 0) / 32768 AS v FROM smp")
def s3_wav_samples(spark, sf_dir):
    """Signals through WAV files and back."""
    return wav.signals(files(spark, sf_dir), normalize=False).select("path", F.posexplode("samples").alias("i", "v"))


@query(f"WITH {SIGNALS} SELECT 'set/' || label || '/' || file || '.wav' AS path, 1 AS channels, 8000 AS sample_rate, 16 AS bits, 44::BIGINT AS data_offset, 128::BIGINT AS data_bytes, 64::BIGINT AS frames FROM sig")
def s5_wav_headers(spark, sf_dir):
    @F.pandas_udf(wav.HEADER)
    def headers(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav.header(bytes(c)) for c in content], columns=[x.split()[0] for x in wav.HEADER.split(", ")])

    return files(spark, sf_dir).select("path", headers("content").alias("h")).select("path", "h.*")


@query(f"""WITH {LONG}, w AS (SELECT file, greatest(-1, least(1, v)) AS v, i FROM smp WHERE i >= 20 AND i < 60), r AS (SELECT file, i, round_even(v * 32767, 0) / 32768 AS v FROM w)
    SELECT 'set/' || s.label || '/' || s.file || '.wav' AS path, count(*)::INT AS n, round(sum(r.v), 6) AS total FROM r JOIN sig s USING (file) GROUP BY ALL""")
def s4_wav_window(spark, sf_dir):
    """A window of each file: from 2.5 ms, 5 ms long."""
    rows = wav.signals(files(spark, sf_dir), start=0.0025, seconds=0.005, normalize=False)
    return rows.select("path", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'pwl' WHEN 2 THEN 'pcen' WHEN 3 THEN 'db' ELSE 'cube' END AS mag_scale, doc_id % 5 < 4 AS valid FROM documents")
def f10_magnitude_scales(spark, sf_dir):
    from corvane.config import MAGNITUDES

    name = F.get(F.array(*map(F.lit, [*MAGNITUDES, "cube"])), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("mag_scale")).withColumn("valid", F.col("mag_scale").isin(MAGNITUDES))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY (((doc_id + 1) * 1103515245 + 3 * 12345) % 2147483647) * 48271 % 2147483647, doc_id))::INT AS place FROM documents")
def k10_epoch_order(spark, sf_dir):
    """The places of files in an epoch's order, by source: a seeded order, not a buffer."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return numbered(rows, ["source"], [catalog.order_key(F.col("doc_id"), 3), F.col("doc_id")]).select("doc_id", F.col("place").cast("int").alias("place"))


# Crops of 8 samples, four at most, then their activity.
TRAINED = f"""e AS (SELECT file, j.t, sum(v * v) / 2 AS e FROM smp, (SELECT unnest(range(0, 63)) AS t) j WHERE i >= j.t AND i < j.t + 2 GROUP BY ALL),
    l AS (SELECT file, quantile_cont(e, 0.75) AS q, max(e) AS top FROM e GROUP BY file),
    a AS (SELECT e.file, t, e, t - row_number() OVER (PARTITION BY e.file ORDER BY t) AS island FROM e JOIN l USING (file) WHERE e >= q AND top >= 1e-10),
    p AS (SELECT file, island, arg_max(t, (e, -t)) AS pk, max(e) AS e FROM a GROUP BY ALL),
    c AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY e DESC, pk) AS k, greatest(0, least(pk - 4, 56)) AS start FROM p UNION ALL SELECT file, 1, 28 FROM l WHERE top < 1e-10),
    {GREEDY.format(most=4, apart=4)}, k AS (SELECT file, unnest(range(0, len(taken))) AS idx, unnest(taken) AS start FROM done),
    ch AS (SELECT k.file, idx, start, label, v FROM k JOIN smp ON smp.file = k.file AND i >= start AND i < start + 8), m AS (SELECT file, idx, median(abs(v)) AS md FROM ch GROUP BY ALL),
    d AS (SELECT file, idx, median(abs(abs(v) - md)) + 1e-10 AS dv FROM ch JOIN m USING (file, idx) GROUP BY ALL),
    r AS (SELECT file, idx, start, label, avg(CASE WHEN abs(v) > md + 2 * dv THEN 1.0 ELSE 0 END) AS r, sum(v) / (max(abs(v)) + 1e-6) AS total FROM ch JOIN m USING (file, idx) JOIN d USING (file, idx) GROUP BY ALL),
    z AS (SELECT *, CASE WHEN r > 0.8 THEN 0 ELSE r END AS act FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY act DESC, idx DESC) AS rank FROM z)"""


@query(f"WITH RECURSIVE {LONG}, {TRAINED} SELECT file, idx::INT AS chunk_idx, start::INT AS start, label::INT AS class_idx, round(total, 6) AS total FROM y WHERE rank <= 2 AND (act >= 0.05 OR rank = 1) AND label <> 9")
def x5_training_samples(spark, sf_dir):
    """Signals to the most active chunks of known labels, in the shape the model takes."""
    rows = signals(spark, sf_dir).select("file", F.concat(F.lit("c"), "label").alias("label"), F.col("x").alias("samples"))
    classes = catalog.class_names(rows.where("label <> 'c9'"))
    done = evaluation.training_samples(rows, classes, 8, most=2, threshold=0.05)
    return done.select("file", "chunk_idx", "start", "class_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


BANDS, SIZE, RATE, COEFFICIENTS = 4, 16, 8_000, 3
KEYS = "file, label, c"


def features_sql(chunk: int, width: int) -> str:
    """feat (name, scale, file, label, c, m, t, v): every frontend's and scale's feature of chunks, rows m of frames t."""
    hop = chunk // width
    normal = lambda x: f"SELECT {KEYS}, m, t, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-10) AS v FROM {x} WHERE t < {width} WINDOW w AS (PARTITION BY file, c)"
    db = lambda x: f"SELECT {KEYS}, m, t, greatest(d, max(d) OVER (PARTITION BY file, c) - 80) AS v FROM (SELECT {KEYS}, m, t, 10 * log10(greatest(v, 1e-10)) - 10 * log10(greatest(max(v) OVER (PARTITION BY file, c), 1e-10)) AS d FROM {x})"
    return f"""{spectra_sql(chunk, SIZE, hop)}, {bank_sql(BANDS, SIZE, RATE)},
    lin AS (SELECT {KEYS}, bin AS m, t, v FROM mag), band AS (SELECT {KEYS}, m, t, sum(w * v) AS v FROM mag JOIN bank USING (bin) GROUP BY ALL), kept AS (SELECT * FROM band WHERE t < {width}),
    pow AS (SELECT {KEYS}, m, t, sum(w * v * v) AS v FROM mag JOIN bank USING (bin) GROUP BY ALL), pdb AS ({db("pow")}),
    cep AS (SELECT {KEYS}, k.k AS m, t, sum(v * cos(pi() * k.k * (2 * m + 1) / {2 * BANDS})) * sqrt(CASE WHEN any_value(k.k) = 0 THEN 1.0 ELSE 2.0 END / {BANDS}) AS v FROM pdb, (SELECT unnest(range(0, {COEFFICIENTS})) AS k) k GROUP BY ALL),
    lg AS (SELECT {KEYS}, m, t, ln(1 + v) AS v FROM kept), n0 AS ({normal("kept")}), pw AS (SELECT {KEYS}, m, t, 0.40 * v + 0.25 * greatest(v - 0.10, 0) + 0.15 * greatest(v - 0.35, 0) + 0.08 * greatest(v - 0.65, 0) AS v FROM n0),
    sq AS (SELECT {KEYS}, m, t, v * v AS v FROM kept), adb AS ({db("sq")}), gc AS ({gain_sql("kept", smoothing_sql(RATE, hop))}),
    feat AS (SELECT 'librosa' AS name, 'none' AS scale, * FROM n0 UNION ALL SELECT 'librosa', 'pwl', * FROM ({normal("pw")}) UNION ALL SELECT 'librosa', 'db', * FROM ({normal("adb")}) UNION ALL SELECT 'librosa', 'pcen', * FROM ({normal("gc")})
        UNION ALL SELECT 'log_mel', 'none', * FROM ({normal("lg")}) UNION ALL SELECT 'mfcc', 'none', * FROM ({normal("cep")}) UNION ALL SELECT 'hybrid', 'none', * FROM ({normal("lin")}))"""


def small_features(width: int) -> list[Feature]:
    """Every frontend and scale, in sizes for signals of 64 samples."""
    make = lambda name, scale="none": Feature(name, RATE, scale, SIZE, width, BANDS, COEFFICIENTS)
    return [*(make("librosa", s) for s in ("none", "pwl", "db", "pcen")), make("log_mel"), make("mfcc"), make("hybrid")]


@query(f"""WITH {LONG}, {features_sql(64, 8)} SELECT name AS frontend, scale, file, m::INT AS row, t::INT AS frame, round(v, 5) AS v FROM feat
    UNION ALL SELECT 'raw', 'none', file, 0, i::INT, round(v, 5) FROM smp""")
def x5_features(spark, sf_dir):
    """Signals to the features of all frontends and magnitude scales."""
    rows = signals(spark, sf_dir).select("file", "x")
    each = [F.struct(F.lit(f.frontend).alias("frontend"), F.lit(f.scale).alias("scale"), features(f)(F.col("x")).alias("f")) for f in [*small_features(8), Feature("raw", RATE)]]
    long = rows.select("file", F.explode(F.array(*each)).alias("e")).select("e.frontend", "e.scale", "file", F.posexplode("e.f").alias("row", "r"))
    return long.select("frontend", "scale", "file", "row", F.posexplode("r").alias("frame", "v")).withColumn("v", F.round("v", 5))


ACTIVE = """q1 AS (SELECT name, scale, file, label, c, median(abs(v)) AS md FROM feat GROUP BY ALL),
    q2 AS (SELECT f.name, f.scale, f.file, f.c, median(abs(abs(v) - md)) + 1e-10 AS dv FROM feat f JOIN q1 USING (name, scale, file, c) GROUP BY ALL),
    q3 AS (SELECT f.name, f.scale, f.file, f.label, f.c, avg(CASE WHEN abs(v) > md + 2 * dv THEN 1.0 ELSE 0 END) AS r, sum(v) AS total FROM feat f JOIN q1 USING (name, scale, file, c) JOIN q2 USING (name, scale, file, c) GROUP BY ALL),
    q4 AS (SELECT *, CASE WHEN r > 0.8 THEN 0 ELSE r END AS a FROM q3), q5 AS (SELECT *, row_number() OVER (PARTITION BY name, scale, file ORDER BY a DESC, c DESC) AS rank FROM q4)"""


@query(f"""WITH {LONG}, {features_sql(16, 4)}, {ACTIVE} SELECT name AS frontend, scale, file, c::INT AS chunk_idx, label::INT AS class_idx, round(total, 4) AS total FROM q5 WHERE rank <= 2 AND (a >= 0.05 OR rank = 1) AND label <> 9""")
def x5_training_features(spark, sf_dir):
    """Signals of known labels to the features of their most active chunks, activity taken of the feature: all frontends and scales but the raw one."""
    rows = signals(spark, sf_dir).select("file", F.concat(F.lit("c"), "label").alias("label"), F.col("x").alias("samples"))
    classes = spark.createDataFrame([(i, f"c{i}") for i in range(9)], "class_idx int, class string")
    out = None
    for f in small_features(4):
        done = evaluation.training_features(rows, classes, f, 16, most=2, threshold=0.05)
        total = F.aggregate(F.flatten("feature"), F.lit(0.0), lambda a, v: a + v)
        part = done.select(F.lit(f.frontend).alias("frontend"), F.lit(f.scale).alias("scale"), "file", "chunk_idx", "class_idx", F.round(total, 4).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def probe(rows: int, frames: int):
    """A linear model over a feature's numbers for ten classes."""
    n, k = np.arange(rows * frames)[:, None], np.arange(10)[None, :]
    return scoring.linear(((n * 5 + k * 3) % 11 - 5) / 8, np.zeros(10))


@query(f"""WITH {LONG}, {features_sql(32, 4)},
    s AS (SELECT name, scale, file, label, c, k.k, 1 / (1 + exp(-sum(v * (((m * 4 + t) * 5 + k.k * 3) % 11 - 5) / 8))) AS score FROM feat, (SELECT unnest(range(0, 10)) AS k) k GROUP BY ALL),
    fact AS (SELECT name, scale, k AS class, CASE WHEN k = label THEN 1 ELSE 0 END AS y, round(avg(score), 4) AS s FROM s GROUP BY name, scale, file, label, k),
    t AS (SELECT name, scale, class, s, sum(y)::BIGINT AS tp, count(*) AS n FROM fact GROUP BY ALL),
    r AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER p AS tp_all FROM t WINDOW w AS (PARTITION BY name, scale, class ORDER BY s DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY name, scale, class))
    SELECT name AS frontend, scale, class::INT AS class, round({AP}, 5) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY ALL""")
def e2_evaluate_spectra(spark, sf_dir):
    """Signals to chunks, to the features of each frontend, to a model's scores, pooled to files, to average precision per class."""
    rows = signals(spark, sf_dir).select("file", "label", F.col("x").alias("samples"))
    out = None
    for f in small_features(4):
        name = "probe {}x{}".format(*f.shape(32))
        scoring.MODELS[name] = probe(*f.shape(32))
        scored = evaluation.truth(evaluation.file_scores(rows, name, 32, 10, feature=f).withColumn("s", F.round("s", 4)), F.col("label"))
        part = scored.select(F.lit(f.frontend).alias("frontend"), F.lit(f.scale).alias("scale"), "class", "y", "s")
        out = part if out is None else out.unionByName(part)
    return ranking.average_precision(out, ["frontend", "scale", "class"]).withColumn("ap", F.round("ap", 5))


@query(f"""WITH {LONG}, c AS (SELECT file, label, j.t, i - j.t * 16 AS n, v FROM smp, (SELECT unnest(range(0, 4)) AS t) j WHERE i >= j.t * 16 AND i < j.t * 16 + 16),
    w AS (SELECT k.k, n.n, ((n.n * 5 + k.k * 3) % 11 - 5) / 8 AS w FROM (SELECT unnest(range(0, 16)) AS n) n, (SELECT unnest(range(0, 10)) AS k) k),
    s AS (SELECT file, label, t, k, 1 / (1 + exp(-(sum(v * w)))) AS score FROM c JOIN w USING (n) GROUP BY file, label, t, k),
    fact AS (SELECT k AS class, CASE WHEN k = label THEN 1 ELSE 0 END AS y, round(avg(score), 5) AS s FROM s GROUP BY file, label, k),
    {STEPS.format(fact="fact")}
    SELECT class::INT AS class, round({AP}, 5) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY class""")
def e1_evaluate(spark, sf_dir):
    """Signals to chunks, to a model's scores, pooled to files, to average precision per class."""
    n, k = np.arange(16)[:, None], np.arange(10)[None, :]
    scoring.MODELS["chunk probe"] = scoring.linear(((n * 5 + k * 3) % 11 - 5) / 8, np.zeros(10))
    rows = signals(spark, sf_dir).select("file", "label", F.col("x").alias("samples"))
    scored = evaluation.file_scores(rows, "chunk probe", 16, 10).withColumn("s", F.round("s", 5))
    found = evaluation.evaluate(evaluation.truth(scored, F.col("label")))["classes"]
    return found.withColumn("ap", F.round("ap", 5))


@query(f"""WITH {LONG}, m AS (SELECT file, sqrt(avg(v * v)) AS rms FROM smp WHERE i >= 32 AND i < 48 GROUP BY file)
    SELECT file, round(rms, 6) AS rms FROM m WHERE rms >= 0.1 ORDER BY (((file + 1) * 1103515245 + 42 * 12345) % 2147483647) * 48271 % 2147483647, file LIMIT 100""")
def c1_calibration_samples(spark, sf_dir):
    """Middle chunks that can be heard, to calibrate a quantized model with: 100 files, a number that is the feature."""
    from corvane.functions import arrays

    cut = signals(spark, sf_dir).select("file", F.posexplode(arrays.chunks(F.col("x"), 16, 16)).alias("chunk_idx", "c")).select("file", "chunk_idx", F.col("c.samples").alias("samples"))
    return evaluation.calibration_samples(cut, 0.1).select("file", F.round(arrays.rms(F.col("samples")), 6).alias("rms"))


@query(f"""WITH {LONG.replace("smp AS", "raw AS")}, wv AS (SELECT file, label, i, round_even(greatest(-1, least(1, v)) * 32767, 0) / 32768 AS v FROM raw), pk AS (SELECT file, max(abs(v)) AS top FROM wv GROUP BY file),
    smp AS (SELECT file, label, i, v / top AS v FROM wv JOIN pk USING (file)), {spectra_sql(64, 16, 8)}, {bank_sql(4, 16, 8_000)}
    SELECT 'set/' || label || '/' || file || '.wav' AS path, t::INT AS frame, m::INT AS mel, round(sum(w * v), 6) AS energy FROM mag JOIN bank USING (bin) WHERE t < 8 AND w > 0 GROUP BY ALL""")
def m35_features_of_files(spark, sf_dir):
    """WAV files to mel energies: decoded, centred frames, filter bank by join."""
    rows = wav.signals(files(spark, sf_dir)).where("error is null").select("path", spectral.stft(16, 8, centred=True, frames=8)(F.col("samples")).alias("s"))
    bands = spectral.mel_weights(spark, 4, 16, 8_000, 150.0)
    return spectral.mel_energies(spectral.long_form(rows, "s"), bands, ["path", "frame"]).withColumn("energy", F.round("energy", 6))


@query(f"WITH {SIGNALS} SELECT label AS class, count(*) AS n FROM sig GROUP BY label")
def d6_label_counts(spark, sf_dir):
    """Positives per class from label vectors in long form."""
    grid = ranking.average_precision(evaluation.truth(signals(spark, sf_dir).select("file", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class"), F.lit(0.5).alias("s")), F.col("label")), ["class"])
    return grid.select("class", F.col("n_positive").alias("n"))
