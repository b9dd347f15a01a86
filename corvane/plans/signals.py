"""Array and signal queries: vectors of 64 floats stand for signals, event values per user for frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import arrays, spectral
from corvane.operators import augment, salience, segments
from corvane.plans.registry import ORACLES, query, table

# Samples on a grid of 1/1024, exact in both engines.
SIGNALS = "sig AS (SELECT vec_id AS file, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024) / 1024) AS x FROM embeddings)"
LONG = f"{SIGNALS}, smp AS (SELECT file, label, unnest(range(0, len(x))) AS i, unnest(x) AS v FROM sig)"


def signals(spark, sf_dir):
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 1024) / 1024)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file"), "label", x.alias("x"))


def rounded(column, places=6):
    """Array elements one by one, rounded: rows that do not depend on how an engine prints arrays."""
    return F.transform(column, lambda v: F.round(v, places))


def listed(df, column, places=6):
    return df.select("file", F.posexplode(rounded(F.col(column), places)).alias("i", "v"))




@query("SELECT doc_id, CASE WHEN n_chars <= 0 THEN 0 WHEN n_chars <= 700 THEN 1 ELSE 1 + (n_chars - 700) // 450 + CASE WHEN (n_chars - 700) % 450 <> 0 THEN 1 ELSE 0 END END::INT AS n FROM documents")
def m2_chunk_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", arrays.n_chunks(F.col("n_chars"), 700, 450).alias("n"))


@query(f"""WITH {SIGNALS}, s AS (SELECT file, x, unnest(list_concat(range(0, 64 - 24 + 1, 10), CASE WHEN (64 - 24) % 10 <> 0 THEN [64 - 24] ELSE [] END)) AS start FROM sig)
    SELECT file, start::INT AS start, round(list_sum(x[start + 1:start + 24]), 6) AS total, len(x[start + 1:start + 24])::INT AS n FROM s""")
def m3_chunks(spark, sf_dir):
    rows = signals(spark, sf_dir).select("file", F.explode(arrays.chunks(F.col("x"), 24, 10)).alias("c"))
    return rows.select("file", "c.start", F.round(arrays.total(F.col("c.samples")), 6).alias("total"), F.size("c.samples").alias("n"))


@query(f"""WITH {SIGNALS}, s AS (SELECT file, x, unnest(list_concat(range(0, 64 - 15 + 1, 11), [49])) AS start FROM sig)
    SELECT file, start::INT AS start, round(list_sum(x[start + 1:start + 15]), 6) AS total FROM s""")
def r4_overlapped_chunks(spark, sf_dir):
    """Chunks of 15 samples that overlap by 4."""
    rows = signals(spark, sf_dir).select("file", F.explode(arrays.chunks(F.col("x"), 15, arrays.overlap_step(15, 4, 1))).alias("c"))
    return rows.select("file", "c.start", F.round(arrays.total(F.col("c.samples")), 6).alias("total"))


@query(f"WITH {LONG}, p AS (SELECT file, max(abs(v)) AS p FROM smp GROUP BY file) SELECT file, i::INT AS i, round(v / p, 6) AS v FROM smp JOIN p USING (file)")
def m4_peak_normalized(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.peak_normalized(F.col("x"))), "x")


@query(f"""WITH {LONG}, p AS (SELECT file, max(abs(v)) AS p FROM smp GROUP BY file), g AS (SELECT file, unnest(range(0, 80)) AS i FROM sig)
    SELECT g.file, g.i::INT AS i, round(coalesce(v / (p + 1e-6), 0), 6) AS v FROM g JOIN p USING (file) LEFT JOIN smp ON smp.file = g.file AND smp.i = g.i""")
def m5_model_input(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.model_input(F.col("x"), 80)), "x")


@query(f"WITH {LONG}, p AS (SELECT file, min(v) AS lo, max(v) AS hi FROM smp GROUP BY file) SELECT file, i::INT AS i, round((v - lo) / (hi - lo + 1e-10), 6) AS v FROM smp JOIN p USING (file)")
def m6_min_max(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.min_max(F.col("x"))), "x")


FRAME = "f AS (SELECT file, j.t, i - j.t * 8 AS n, v FROM smp, (SELECT unnest(range(0, 7)) AS t) j WHERE i >= j.t * 8 AND i < j.t * 8 + 16)"


@query(f"""WITH {LONG}, {FRAME}, k AS (SELECT unnest(range(0, 9)) AS bin),
    d AS (SELECT file, t, bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 15)) * cos(2 * pi() * n * bin / 16)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 15)) * sin(2 * pi() * n * bin / 16)) AS im FROM f, k GROUP BY ALL)
    SELECT file, t::INT AS frame, bin::INT AS bin, round(sqrt(re * re + im * im), 5) AS magnitude FROM d""")
def m8_stft_symmetric(spark, sf_dir):
    """Magnitudes of frames under a symmetric window, not centred."""
    rows = signals(spark, sf_dir).select("file", spectral.stft(16, 8, symmetric=True)(F.col("x")).alias("s"))
    return spectral.long_form(rows, "s").select("file", "frame", "bin", F.round("magnitude", 5).alias("magnitude"))


@query(f"""WITH {LONG}, c AS (SELECT s.file, j.t, m.n, coalesce(p.v, 0) AS v FROM (SELECT file FROM sig) s CROSS JOIN (SELECT unnest(range(0, 9)) AS t) j CROSS JOIN (SELECT unnest(range(0, 16)) AS n) m
        LEFT JOIN smp p ON p.file = s.file AND p.i = j.t * 8 + m.n - 8), k AS (SELECT unnest(range(0, 9)) AS bin),
    d AS (SELECT file, t, bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * n * bin / 16)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * n * bin / 16)) AS im FROM c, k GROUP BY ALL)
    SELECT file, t::INT AS frame, bin::INT AS bin, round(sqrt(re * re + im * im), 5) AS magnitude FROM d WHERE t < 8""")
def m7_stft_centred(spark, sf_dir):
    """Magnitudes of centred frames under a periodic window, as many frames as the hop gives."""
    rows = signals(spark, sf_dir).select("file", spectral.stft(16, 8, centred=True, frames=8)(F.col("x")).alias("s"))
    return spectral.long_form(rows, "s").select("file", "frame", "bin", F.round("magnitude", 5).alias("magnitude"))


@query(f"""WITH {LONG}, {FRAME}, k AS (SELECT unnest(range(0, 9)) AS bin),
    d AS (SELECT file, t, bin, sum(v * cos(2 * pi() * n * bin / 16)) AS re, sum(v * sin(2 * pi() * n * bin / 16)) AS im FROM f, k GROUP BY ALL)
    SELECT file, t::INT AS frame, bin::INT AS bin, round(sqrt(re * re + im * im), 10) AS magnitude FROM d""")
def m34_real_fft(spark, sf_dir):
    rows = signals(spark, sf_dir).select("file", spectral.stft(16, 8, window=False)(F.col("x")).alias("s"))
    return spectral.long_form(rows, "s").select("file", "frame", "bin", F.round("magnitude", 10).alias("magnitude"))


MEL = """e AS (SELECT m, 15 + ln(m_hz / 1000) * 27 / ln(6.4) AS x FROM (SELECT 0 AS m, 12000.0::DOUBLE AS m_hz)),
top AS (SELECT x AS hi, 150.0::DOUBLE * 3 / 200 AS lo FROM e),
edge AS (SELECT i, CASE WHEN z < 15 THEN z * 200 / 3 ELSE 1000 * exp((z - 15) * ln(6.4) / 27) END AS hz FROM (SELECT i, lo + (hi - lo) * i / 17 AS z FROM top, (SELECT unnest(range(0, 18)) AS i) q)),
w AS (SELECT a.i AS mel, b.bin, greatest(0, least((b.bin * 187.5 - a.hz) / (c.hz - a.hz), (d.hz - b.bin * 187.5) / (d.hz - c.hz))) * 2 / (d.hz - a.hz) AS w
      FROM edge a JOIN edge c ON c.i = a.i + 1 JOIN edge d ON d.i = a.i + 2, (SELECT unnest(range(0, 65)) AS bin) b)"""


@query(f"""WITH {LONG}, {MEL}, k AS (SELECT label, count(*) AS n FROM sig GROUP BY label) SELECT label, mel::INT AS mel, bin::INT AS bin, n, round(w, 8) AS weight FROM w, k WHERE w > 0""")
def m9_mel_weights(spark, sf_dir):
    """The nonzero weights of 16 filters from 150 Hz at 24 kHz over the bins of the signals' spectra, and how many frames of each label have them."""
    rows = signals(spark, sf_dir).select("label", spectral.stft(128, 64)(F.col("x")).alias("s"))
    bins = spectral.long_form(rows, "s").groupBy("label", "bin").agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(spectral.mel_weights(spark, 16, 128, 24_000, 150.0)), "bin").select("label", "mel", "bin", "n", F.round("weight", 8).alias("weight"))


@query(f"WITH {LONG}, {MEL} SELECT file, mel::INT AS mel, round(sum(w * abs(v)), 8) AS energy FROM smp JOIN w ON bin = i WHERE w > 0 GROUP BY ALL")
def m10_mel_energies(spark, sf_dir):
    rows = signals(spark, sf_dir).select("file", F.posexplode("x").alias("bin", "v")).select("file", "bin", F.abs("v").alias("magnitude"))
    return spectral.mel_energies(rows, spectral.mel_weights(spark, 16, 128, 24_000, 150.0), ["file"]).withColumn("energy", F.round("energy", 8))


@query("SELECT event_id, round(CASE WHEN value * 30 < 1000 THEN value * 30 * 3 / 200 ELSE 15 + ln(value * 30 / 1000) * 27 / ln(6.4) END, 6) AS mel FROM events")
def m11_hz_to_mel(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(arrays.hz_to_mel(F.col("value") * 30), 6).alias("mel"))


@query(f"WITH {LONG}, l AS (SELECT file, i, ln(1 + abs(v)) AS v FROM smp), p AS (SELECT file, min(v) AS lo, max(v) AS hi FROM l GROUP BY file) SELECT file, i::INT AS i, round((v - lo) / (hi - lo + 1e-10), 6) AS v FROM l JOIN p USING (file)")
def m13_log_mel(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.min_max(F.transform("x", lambda v: F.log1p(F.abs(v))))), "x")


@query(f"""WITH {LONG}, s AS (SELECT file, i, 10 * log10(greatest(v * v, 1e-10)) - 10 * log10(greatest(max(v * v) OVER (PARTITION BY file), 1e-10)) AS b FROM smp),
    b AS (SELECT file, i, greatest(b, max(b) OVER (PARTITION BY file) - 80) AS b FROM s), c AS (SELECT unnest(range(0, 12)) AS c),
    d AS (SELECT file, c, sum(b * cos(pi() * c * (2 * i + 1) / 128)) * sqrt(CASE WHEN c = 0 THEN 1.0 ELSE 2.0 END / 64) AS v FROM b, c GROUP BY file, c), r AS (SELECT file, min(v) AS lo, max(v) AS hi FROM d GROUP BY file)
    SELECT file, c::INT AS i, round((v - lo) / (hi - lo + 1e-10), 6) AS v FROM d JOIN r USING (file)""")
def m12_cepstra(spark, sf_dir):
    return listed(signals(spark, sf_dir).select("file", spectral.cepstra(12)(F.transform("x", lambda v: v * v)).alias("x")), "x")


PWL = "0.40 * {x} + 0.25 * greatest({x} - 0.10, 0) + 0.15 * greatest({x} - 0.35, 0) + 0.08 * greatest({x} - 0.65, 0)"


@query(f"WITH {LONG} SELECT file, i::INT AS i, round({PWL.format(x='abs(v)')}, 6) AS v FROM smp")
def m15_piecewise_linear(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", F.transform("x", lambda v: arrays.pwl(F.abs(v)))), "x")


@query(f"""WITH {LONG}, p AS (SELECT file, min(v) AS lo, max(v) AS hi FROM smp GROUP BY file), n AS (SELECT file, i, (v - lo) / (hi - lo + 1e-10) AS v FROM smp JOIN p USING (file)),
    q AS (SELECT file, i, {PWL.format(x='v')} AS v FROM n), r AS (SELECT file, min(v) AS lo, max(v) AS hi FROM q GROUP BY file) SELECT file, i::INT AS i, round((v - lo) / (hi - lo + 1e-10), 6) AS v FROM q JOIN r USING (file)""")
def m14_piecewise_linear_spectrum(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.min_max(F.transform(arrays.min_max(F.col("x")), arrays.pwl))), "x")


@query(f"WITH {LONG}, y AS (SELECT file, i, greatest(abs(v) - 0.6 * abs(v), 0) AS y FROM smp) SELECT file, i::INT AS i, round(greatest(0.15 * y + 0.45 * greatest(y - 0.2, 0), 0), 6) AS v FROM y")
def m17_gain_control(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", F.transform("x", lambda v: arrays.pcen_like(F.abs(v)))), "x")


# Centred spectra of chunks of signals: `mag` has every frame's bins, `frames` of which a feature keeps.
def spectra_sql(chunk: int, size: int, hop: int) -> str:
    frames = chunk // hop + 1
    return f"""ch AS (SELECT file, label, i // {chunk} AS c, i % {chunk} AS i, v FROM smp),
    pad AS (SELECT s.file, s.label, s.c, t.t, n.n, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT file, label, c FROM ch) s CROSS JOIN (SELECT unnest(range(0, {frames})) AS t) t
        CROSS JOIN (SELECT unnest(range(0, {size})) AS n) n LEFT JOIN ch p ON p.file = s.file AND p.c = s.c AND p.i = t.t * {hop} + n.n - {size // 2}),
    dft AS (SELECT file, label, c, t, bin, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / {size})) * cos(2 * pi() * n * bin / {size})) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / {size})) * sin(2 * pi() * n * bin / {size})) AS im
        FROM pad, (SELECT unnest(range(0, {size // 2 + 1})) AS bin) k GROUP BY ALL),
    mag AS (SELECT file, label, c, t, bin, sqrt(re * re + im * im) AS v FROM dft)"""


def bank_sql(bands: int, size: int, rate: int) -> str:
    """Weights of `bands` triangles from 150 Hz to half the rate: bank (m, bin, w)."""
    return f"""mel AS (SELECT 150.0::DOUBLE * 3 / 200 AS lo, CASE WHEN {rate / 2} < 1000 THEN {rate / 2}::DOUBLE * 3 / 200 ELSE 15 + ln({rate / 2}::DOUBLE / 1000) * 27 / ln(6.4) END AS hi),
    hz AS (SELECT i, CASE WHEN z < 15 THEN z * 200 / 3 ELSE 1000 * exp((z - 15) * ln(6.4) / 27) END AS hz FROM (SELECT i, lo + (hi - lo) * i / {bands + 1} AS z FROM mel, (SELECT unnest(range(0, {bands + 2})) AS i) q)),
    bank AS (SELECT a.i AS m, b.bin, greatest(0, least((b.f - a.hz) / (d.hz - a.hz), (e.hz - b.f) / (e.hz - d.hz))) * 2 / (e.hz - a.hz) AS w
        FROM hz a JOIN hz d ON d.i = a.i + 1 JOIN hz e ON e.i = a.i + 2, (SELECT unnest(range(0, {size // 2 + 1})) AS bin, unnest(range(0, {size // 2 + 1}))::DOUBLE * {rate} / {size} AS f) b)"""


def gain_sql(source: str, b: str) -> str:
    """Gain control of magnitudes (key columns, t, v): the filter's value is a weighted sum of all frames so far and its start."""
    return f"""SELECT a.file, a.label, a.c, a.m, a.t, sqrt(2.0::DOUBLE) * (exp(0.5 * ln(1 + any_value(a.v) * 2147483648.0 * exp(-0.98 * (ln(1e-6::DOUBLE) + ln(1 + (power(1 - {b}, a.t + 1) + sum({b} * power(1 - {b}, a.t - p.t) * p.v * 2147483648.0)) / 1e-6::DOUBLE))) / 2)) - 1) AS v
        FROM {source} a JOIN {source} p ON p.file = a.file AND p.c = a.c AND p.m = a.m AND p.t <= a.t GROUP BY a.file, a.label, a.c, a.m, a.t"""


def smoothing_sql(rate: int, hop: int) -> str:
    frames = 0.4 * rate / hop
    return f"((sqrt(1 + 4 * {frames}::DOUBLE * {frames}::DOUBLE) - 1) / (2 * {frames}::DOUBLE * {frames}::DOUBLE))"


@query(f"""WITH {LONG}, {spectra_sql(64, 16, 8)}, x AS (SELECT file, label, c, bin AS m, t, v FROM mag WHERE t < 8), g AS ({gain_sql("x", smoothing_sql(8_000, 8))}),
    r AS (SELECT file, min(v) AS lo, max(v) AS hi FROM g GROUP BY file) SELECT file, t::INT AS frame, m::INT AS bin, round((v - lo) / (hi - lo + 1e-10), 6) AS magnitude FROM g JOIN r USING (file)""")
def m16_pcen(spark, sf_dir):
    """Per-channel energy normalization of spectrograms at the signals' rate and hop, scaled to 0 to 1: an IIR filter along the frames."""
    rows = signals(spark, sf_dir).select("file", spectral.stft(16, 8, centred=True, frames=8)(F.col("x")).alias("s"))
    gained = rows.select("file", spectral.pcen(rate=8_000, hop=8)(F.col("s")).alias("s"))
    ends = F.struct(F.array_min(F.flatten("s")).alias("lo"), F.array_max(F.flatten("s")).alias("hi"))
    scaled = gained.select("file", arrays.element_of(ends, lambda r: F.transform("s", lambda f: F.transform(f, lambda v: (v - r["lo"]) / (r["hi"] - r["lo"] + 1e-10)))).alias("s"))
    return spectral.long_form(scaled, "s").select("file", "frame", "bin", F.round("magnitude", 6).alias("magnitude"))


@query(f"""WITH {LONG}, p AS (SELECT file, max(greatest(abs(v), 1e-5)) AS top FROM smp GROUP BY file)
    SELECT file, i::INT AS i, round(greatest(20 * log10(greatest(abs(v), 1e-5)) - 20 * log10(top), -80), 6) AS v FROM smp JOIN p USING (file)""")
def m18_decibels_below_top(spark, sf_dir):
    """The host's form: against the loudest, over a range of 80 dB."""
    return listed(signals(spark, sf_dir).withColumn("x", arrays.decibels_below_top(F.col("x"))), "x")


@query(f"WITH {LONG} SELECT file, i::INT AS i, round(10 * log10(greatest(abs(v), 1e-6)), 6) AS v FROM smp")
def m18_decibels(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", F.transform("x", lambda v: arrays.decibels(F.abs(v)))), "x")


@query(f"WITH {LONG} SELECT file, round(avg(v) / (stddev_pop(v) + 1e-10), 6) AS snr FROM smp GROUP BY file")
def m19_signal_to_noise(spark, sf_dir):
    return signals(spark, sf_dir).select("file", F.round(arrays.signal_to_noise(F.col("x")), 6).alias("snr"))


ACTIVITY = "a1 AS (SELECT file, median(abs(v)) AS m FROM smp GROUP BY file), a2 AS (SELECT smp.file, any_value(m) AS m, median(abs(abs(v) - m)) AS d FROM smp JOIN a1 USING (file) GROUP BY smp.file), a3 AS (SELECT smp.file, any_value(label) AS label, avg(CASE WHEN abs(v) > m + 2 * (d + 1e-10) THEN 1.0 ELSE 0 END) AS r FROM smp JOIN a2 USING (file) GROUP BY smp.file), act AS (SELECT file, label, CASE WHEN r > 0.8 THEN 0 ELSE r END AS r FROM a3)"


@query(f"WITH {LONG}, {ACTIVITY} SELECT file, round(r, 6) AS activity FROM act")
def m20_activity_ratio(spark, sf_dir):
    return signals(spark, sf_dir).select("file", F.round(salience.activity_ratio(F.col("x")), 6).alias("activity"))


# Starts taken greedily from ranked candidates c (file, k, start), as many as {most} and {apart} apart.
GREEDY = """g AS (SELECT DISTINCT file, 0::BIGINT AS k, []::BIGINT[] AS taken FROM c UNION ALL
        SELECT g.file, c.k, CASE WHEN len(taken) >= {most} OR len(list_filter(taken, lambda t: abs(t - c.start) < {apart})) > 0 THEN taken ELSE list_append(taken, c.start::BIGINT) END FROM g JOIN c ON c.file = g.file AND c.k = g.k + 1),
    done AS (SELECT file, arg_max(taken, k) AS taken FROM g GROUP BY file)"""


@query(f"""WITH RECURSIVE {LONG}, e AS (SELECT file, j.t, sum(v * v) / 4 AS e FROM smp, (SELECT unnest(range(0, 31)) AS t) j WHERE i >= j.t * 2 AND i < j.t * 2 + 4 GROUP BY ALL),
    l AS (SELECT file, quantile_cont(e, 0.75) AS q, max(e) AS top FROM e GROUP BY file),
    a AS (SELECT e.file, t, e, t - row_number() OVER (PARTITION BY e.file ORDER BY t) AS island FROM e JOIN l USING (file) WHERE e >= q AND top >= 1e-10),
    p AS (SELECT file, island, arg_max(t, (e, -t)) AS pk, max(e) AS e FROM a GROUP BY ALL),
    c AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY e DESC, pk) AS k, greatest(0, least(pk * 2 - 8, 48)) AS start FROM p UNION ALL SELECT file, 1, 24 FROM l WHERE top < 1e-10),
    {GREEDY.format(most=3, apart=8)} SELECT file, array_to_string(taken, ',') AS starts FROM done""")
def m21_smart_crop(spark, sf_dir):
    """Starts of chunks of 16 around the loudest regions of each signal."""
    return signals(spark, sf_dir).select("file", F.array_join(salience.crops(F.col("x"), 16, 3), ",").alias("starts"))


@query(f"""WITH {LONG}, f AS (SELECT file, j.t, sum(v * v) / 16 AS e FROM smp, (SELECT unnest(range(0, 7)) AS t) j WHERE i >= j.t * 8 AND i < j.t * 8 + 16 GROUP BY ALL)
    SELECT file, t::INT AS i, round(e, 6) AS v FROM f""")
def w12_short_time_energy(spark, sf_dir):
    return listed(signals(spark, sf_dir).withColumn("x", arrays.short_time_energy(F.col("x"), 16, 8)), "x")


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
    l AS (SELECT user_id, quantile_cont(value, 0.75) AS q FROM events GROUP BY user_id), a AS (SELECT e.*, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e JOIN l USING (user_id) WHERE value >= q)
    SELECT user_id, min(i)::INT AS first, max(i)::INT AS last, arg_max(i, (value, -i))::INT AS peak, max(value) AS peak_value FROM a GROUP BY user_id, g""")
def w13_active_regions(spark, sf_dir):
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i")
    return salience.active_regions(table(spark, sf_dir, "events").select("user_id", "value", place), "value", "user_id", "i")


@query(f"""WITH {LONG}, {ACTIVITY}, k AS (SELECT label, file, r, row_number() OVER (PARTITION BY label ORDER BY r DESC, file DESC) AS k FROM act)
    SELECT label, file, round(r, 6) AS activity, k::INT AS rank FROM k WHERE r >= 0.25 OR k = 1""")
def k1_by_activity(spark, sf_dir):
    rows = signals(spark, sf_dir).select("label", "file", salience.activity_ratio(F.col("x")).alias("activity"))
    return salience.ranked_chunks(rows, "activity", 0.25, file="label", chunk="file").withColumn("activity", F.round("activity", 6))


SNR = "n1 AS (SELECT file, any_value(label) AS label, avg(abs(v)) / (stddev_pop(abs(v)) + 1e-10) AS s FROM smp GROUP BY file), n2 AS (SELECT label, file, round(s / (max(s) OVER (PARTITION BY label) + 1e-10), 6) AS s FROM n1)"


@query(f"WITH {LONG}, {SNR}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, file DESC) AS k FROM n2) SELECT label, file, s AS snr, k::INT AS rank FROM k WHERE s >= 0.7 OR k = 1")
def k2_by_signal_to_noise(spark, sf_dir):
    rows = signals(spark, sf_dir).select("label", "file", arrays.signal_to_noise(F.transform("x", F.abs)).alias("snr"))
    scaled = salience.relative(rows, "snr", "label").withColumn("snr", F.round("snr", 6))
    return salience.ranked_chunks(scaled, "snr", 0.7, file="label", chunk="file")


@query(f"WITH {LONG}, {SNR}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, file DESC) AS k FROM n2) SELECT label, file, s AS snr, k::INT AS rank FROM k WHERE k <= 5")
def k3_chunk_cap(spark, sf_dir):
    rows = signals(spark, sf_dir).select("label", "file", arrays.signal_to_noise(F.transform("x", F.abs)).alias("snr"))
    scaled = salience.relative(rows, "snr", "label").withColumn("snr", F.round("snr", 6))
    return salience.ranked_chunks(scaled, "snr", 0.0, 5, file="label", chunk="file")


PICK = "(((file + 1) * 1103515245 + 42 * 12345) % 2147483647) * 48271 % 2147483647"


@query(f"WITH k AS (SELECT label, vec_id AS file, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 100 < 10 THEN 0 ELSE 1 END, {PICK.replace('file', 'vec_id')}, vec_id) AS k FROM embeddings) SELECT label, file, k::INT AS rank FROM k WHERE k <= 4")
def k4_picked_samples(spark, sf_dir):
    """Four chunks of each file in a seeded order, marked ones first."""
    from corvane.operators.catalog import order_key

    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("file"))
    return salience.picked(rows, 4, F.struct(order_key(F.col("file")), F.col("file")), F.col("file") % 100 < 10, "label")


@query(f"""WITH RECURSIVE {LONG}, c AS (SELECT file, i AS start, row_number() OVER (PARTITION BY file ORDER BY abs(v) DESC, i) AS k FROM smp),
    {GREEDY.format(most=4, apart=8)} SELECT file, array_to_string(taken, ',') AS starts FROM done""")
def k9_greedy_non_overlap(spark, sf_dir):
    """Starts of samples by falling size, none nearer than 8 to one taken before."""
    order = F.transform(F.array_sort(F.transform("x", lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("i")))), lambda s: s["i"])
    return signals(spark, sf_dir).select("file", F.array_join(salience.apart(order, 8, 4), ",").alias("starts"))


@query(f"WITH {LONG}, r AS (SELECT file, sqrt(avg(v * v)) AS rms FROM smp GROUP BY file) SELECT file, round(rms, 6) AS rms FROM r WHERE rms >= 0.125")
def f6_not_silent(spark, sf_dir):
    return signals(spark, sf_dir).select("file", arrays.rms(F.col("x")).alias("rms")).where("rms >= 0.125").withColumn("rms", F.round("rms", 6))


@query(f"WITH {SIGNALS} SELECT file, x[len(x) // 2 + 1] AS middle FROM sig")
def f7_centre(spark, sf_dir):
    return signals(spark, sf_dir).select("file", arrays.centre(F.col("x")).alias("middle"))


def drawn(tag: str, key: str = "file") -> str:
    """`augment.uniform` in SQL; the tag is an SQL text."""
    return f"((('0x' || substr(md5('42:' || {tag} || ':' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296)"


# Batches of about 256, a quarter of each mixed with one or two of its rows, gains of a Dirichlet distribution of 0.2.
MIXED = f"""nb AS (SELECT greatest(1, ceil(count(*) / 256)) AS b FROM sig), bt AS (SELECT file, floor({drawn("'batch'")} * b) AS batch FROM sig, nb),
    pl AS (SELECT file, batch, row_number() OVER (PARTITION BY batch ORDER BY {drawn("'order'")}, file) AS place, count(*) OVER (PARTITION BY batch) AS m FROM bt),
    ch AS (SELECT file, batch, place, m, least(CASE WHEN {drawn("'sources'")} < 0.5 THEN 2 ELSE 3 END, m + 1) AS n, floor({drawn("'first'")} * m)::BIGINT AS p, {drawn("'second'")} AS u FROM pl WHERE place <= floor(m * 0.25)),
    sc AS (SELECT file, batch, j, n, CASE j WHEN 1 THEN place WHEN 2 THEN p + 1 ELSE (p + 1 + floor(u * (m - 1))::BIGINT) % m + 1 END AS place FROM ch, (SELECT unnest(range(1, 4)) AS j) q WHERE j <= n),
    tr AS (SELECT file, j, a, pow({drawn("'gain:' || a || ':' || j")}, 5) AS x FROM sc, (SELECT unnest(range(1, 12)) AS a) q), su AS (SELECT file, a, sum(x) AS t FROM tr GROUP BY ALL HAVING sum(x) <= 1),
    ok AS (SELECT file, min(a) AS a, arg_min(t, a) AS t FROM su GROUP BY file), ga AS (SELECT tr.file, j, x / t AS g FROM tr JOIN ok ON ok.file = tr.file AND ok.a = tr.a),
    pr AS (SELECT sc.file, pl.file AS partner, sum(coalesce(g, 1 / n)) AS g FROM sc JOIN pl ON pl.batch = sc.batch AND pl.place = sc.place LEFT JOIN ga ON ga.file = sc.file AND ga.j = sc.j GROUP BY ALL)"""


@query(f"""WITH {LONG}, {MIXED}, lab AS (SELECT file, c.c, CASE WHEN label = c.c THEN 1.0 ELSE 0.0 END AS y FROM sig, (SELECT unnest(range(0, 10)) AS c) c)
    SELECT pr.file, 'sample' AS part, s.i::INT AS i, round(sum(pr.g * s.v), 6) AS v FROM pr JOIN smp s ON s.file = pr.partner GROUP BY pr.file, s.i
    UNION ALL SELECT file, 'sample', i::INT, round(v, 6) FROM smp WHERE file NOT IN (SELECT file FROM pr)
    UNION ALL SELECT pr.file, 'label', c::INT, max(0.9 * y + 0.01) FROM pr JOIN lab ON lab.file = pr.partner GROUP BY pr.file, c
    UNION ALL SELECT file, 'label', c::INT, 0.9 * y + 0.01 FROM lab WHERE file NOT IN (SELECT file FROM pr)""")
def g1_mixup(spark, sf_dir):
    """A quarter of each batch mixed with one or two others of it; samples and smoothed labels."""
    rows = signals(spark, sf_dir).select(F.col("file").alias("id"), F.col("x").alias("samples"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (c == F.col("label")).cast("double")).alias("y"))
    done = augment.mixed(rows, augment.mix_partners(rows, 0.25, 0.2), smoothing=0.1)
    samples, labels = (done.select(F.col("id").alias("file"), F.lit(part).alias("part"), F.posexplode(rounded(F.col(c))).alias("i", "v")) for part, c in (("sample", "samples"), ("label", "y")))
    return samples.unionByName(labels)


@query(f"""WITH {LONG}, m AS (SELECT file, j, ((((file * 31 + j + 1) * 1103515245 + 42 * 12345) % 2147483647) * 48271 % 2147483647) % 3 AS w FROM sig, (SELECT unnest(range(0, 2)) AS j) q),
    s AS (SELECT file, w, ((((file * 31 + j + 1) * 1103515245 + 43 * 12345) % 2147483647) * 48271 % 2147483647) % greatest(1, 8 - w) AS b FROM m)
    SELECT file, i::INT AS i, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.file = smp.file AND smp.i // 8 >= b AND smp.i // 8 < b + w) THEN 0 ELSE v END::DOUBLE AS v FROM smp""")
def g2_spectrum_masks(spark, sf_dir):
    """Two bands of an 8 by 8 spectrum zeroed at seeded places."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, F.lit(8)))
    done = augment.masked_spectrum(rows, augment.seeded_masks(F.col("file"), 8, 3, 2), "freq")
    return signals(spark, sf_dir).select("file", F.posexplode(F.flatten(done)).alias("i", "v"))


@query(f"WITH {LONG}, c AS (SELECT unnest(range(0, 10)) AS c) SELECT file, c::INT AS i, round(0.9 * CASE WHEN label = c THEN 1 ELSE 0 END + 0.1 / 10, 6) AS v FROM sig, c")
def l2_smoothed_labels(spark, sf_dir):
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: arrays.smoothed((c == F.col("label")).cast("double"), 0.1, 10))
    return listed(signals(spark, sf_dir).withColumn("y", y), "y")


@query(f"WITH {LONG}, a AS (SELECT file, i, greatest(v, 0) AS v FROM smp), p AS (SELECT file, max(v) AS p FROM a GROUP BY file) SELECT file, i::INT AS i, round({PWL.format(x='(v / (p + 1e-6))')}, 6) AS v FROM a JOIN p USING (file)")
def m35_hybrid_frontend(spark, sf_dir):
    """Rectified, scaled by the largest value, compressed."""
    positive = F.transform("x", lambda v: F.greatest(v, F.lit(0.0)))
    scaled = arrays.element_of(positive, lambda a: F.transform(a, lambda v: arrays.pwl(v / (F.array_max(a) + 1e-6))))
    return listed(signals(spark, sf_dir).withColumn("x", scaled), "x")


UP, DOWN, TAPS = spectral.polyphase(4, 3)


@query(f"""WITH {LONG}, tp AS (SELECT {[float(t) for t in TAPS]}::DOUBLE[] AS taps), k AS (SELECT unnest(range(0, 48)) AS k)
    SELECT file, k::INT AS i, round(sum(v * coalesce(taps[k * {DOWN} + {len(TAPS) // 2} - i * {UP} + 1], 0)), 6) AS v FROM smp, k, tp WHERE k * {DOWN} + {len(TAPS) // 2} - i * {UP} BETWEEN 0 AND {len(TAPS) - 1} GROUP BY ALL""")
def m1_resampled(spark, sf_dir):
    """From 64 to 48 samples by a windowed sinc in polyphase."""
    return listed(signals(spark, sf_dir).select("file", spectral.resampled(4, 3)(F.col("x")).alias("x")), "x")


def in_segments(spark, sf_dir):
    """Signals in segments of 20 samples."""
    return segments.cut(signals(spark, sf_dir).withColumnRenamed("x", "samples"), 20)


@query(ORACLES["w12_short_time_energy"])
def w12_segment_energy(spark, sf_dir):
    """Energies of frames that lie across segments."""
    return segments.energies(in_segments(spark, sf_dir), 16, 8, 20).select("file", F.col("t").cast("int").alias("i"), F.round("energy", 6).alias("v"))


@query(ORACLES["m20_activity_ratio"])
def m20_segment_activity(spark, sf_dir):
    """Activity of recordings in segments."""
    return segments.activity(in_segments(spark, sf_dir), 20).select("file", F.round("activity", 6).alias("activity"))


@query(ORACLES["m21_smart_crop"])
def m21_segment_crops(spark, sf_dir):
    """Crops of recordings in segments."""
    return segments.crops(in_segments(spark, sf_dir), 20, 16, 3).select("file", F.array_join("starts", ",").alias("starts"))


@query(ORACLES["m16_pcen"])
def m16_segment_pcen(spark, sf_dir):
    """Gain control of spectrograms in segments of three frames, each from the state the one before leaves."""
    rows = signals(spark, sf_dir).select("file", spectral.stft(16, 8, centred=True, frames=8)(F.col("x")).alias("s"))
    gained = segments.gain_controlled(segments.cut(rows, 3, samples="s").withColumnRenamed("samples", "frames"), 8_000, 8)
    long = gained.select("file", "segment", F.posexplode("frames").alias("t", "bins")).select("file", (F.col("segment") * 3 + F.col("t")).alias("frame"), F.posexplode("bins").alias("bin", "v"))
    ends = long.groupBy("file").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return long.join(ends, "file").select("file", "frame", "bin", F.round((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10), 6).alias("magnitude"))
