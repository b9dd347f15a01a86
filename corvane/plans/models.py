"""Agreement, quantization, profiles, losses and schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays
from corvane.operators import agreement, scoring, training
from corvane.plans.registry import query, table
from corvane.plans.signals import LONG, signals

QUANT = f"""{LONG}, rg AS (SELECT file, min(v) AS lo, greatest((max(v) - min(v)) / 255, 1e-10) AS st FROM smp GROUP BY file),
q AS (SELECT file, i, v, round_even((v - lo) / st, 0) * st + lo AS w FROM smp JOIN rg USING (file))"""


def pairs(spark, sf_dir):
    left = signals(spark, sf_dir).select(F.col("file").alias("id"), F.col("x").alias("values"))
    return left, left.withColumn("values", arrays.fake_quantized(F.col("values")))


@query(f"WITH {QUANT} SELECT file, i::INT AS i, round(w, 12) AS v FROM q")
def m27_fake_quantized(spark, sf_dir):
    rows = signals(spark, sf_dir)
    return rows.select("file", F.posexplode(F.transform(arrays.fake_quantized(F.col("x")), lambda v: F.round(v, 12))).alias("i", "v"))


@query(f"""WITH {LONG}, c AS (SELECT label, i, v, file FROM smp), rg AS (SELECT label, i, min(v) AS lo, greatest((max(v) - min(v)) / 255, 1e-10) AS st FROM c GROUP BY ALL)
    SELECT label, file, c.i::INT AS i, round(round_even((v - lo) / st, 0) * st + lo, 12) AS v FROM c JOIN rg USING (label, i)""")
def m27_fake_quantized_per_channel(spark, sf_dir):
    """A tensor per label; the vectors' elements are its channels."""
    rows = signals(spark, sf_dir).select("label", "file", F.posexplode("x").alias("i", "v"))
    channel = rows.groupBy("label", "i").agg(F.min("v").alias("lo"), F.greatest((F.max("v") - F.min("v")) / 255, F.lit(1e-10)).alias("by"))
    return rows.join(channel, ["label", "i"]).select("label", "file", "i", F.round(F.rint((F.col("v") - F.col("lo")) / F.col("by")) * F.col("by") + F.col("lo"), 12).alias("v"))


METRICS = """mt AS (SELECT file, avg(v) AS mv, avg(w) AS mw FROM q GROUP BY file),
e AS (SELECT q.file, sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) AS cosine, sum((v - mv) * (w - mw)) / sqrt(sum((v - mv) * (v - mv)) * sum((w - mw) * (w - mw))) AS pearson,
      avg((v - w) * (v - w)) AS mse, avg(abs(v - w)) AS mae FROM q JOIN mt USING (file) GROUP BY q.file)"""


@query(f"WITH {QUANT}, {METRICS} SELECT file AS id, round(cosine, 7) AS cosine, round(pearson, 7) AS pearson, round(mse, 9) AS mse, round(mae, 7) AS mae FROM e")
def m24_agreement(spark, sf_dir):
    """Cosine, correlation and errors of signals and their quantized copies."""
    return agreement.compared(*pairs(spark, sf_dir)).select("id", F.round("cosine", 7).alias("cosine"), F.round("pearson", 7).alias("pearson"), F.round("mse", 9).alias("mse"), F.round("mae", 7).alias("mae"))


@query(f"""WITH {QUANT}, {METRICS}, u AS (SELECT 'cosine' AS metric, cosine AS v FROM e UNION ALL SELECT 'mse', mse FROM e UNION ALL SELECT 'mae', mae FROM e UNION ALL SELECT 'pearson', pearson FROM e)
    SELECT metric, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std, round(min(v), 7) AS min, round(max(v), 7) AS max FROM u GROUP BY metric""")
def a15_agreement_summary(spark, sf_dir):
    found = agreement.agreement_summary(agreement.compared(*pairs(spark, sf_dir)))
    return found.select("metric", *(F.round(c, 7).alias(c) for c in ("mean", "std", "min", "max")))


@query(f"""WITH {QUANT}, {METRICS}, u AS (SELECT file % 5 AS run, 'cosine' AS metric, cosine AS v FROM e UNION ALL SELECT file % 5, 'mae', mae FROM e),
    r AS (SELECT run, metric, avg(v) AS v FROM u GROUP BY ALL) SELECT metric, round(CASE WHEN metric = 'cosine' THEN min(v) ELSE max(v) END, 7) AS worst, round(avg(v), 7) AS mean FROM r GROUP BY metric""")
def a16_worst_of_runs(spark, sf_dir):
    each = agreement.compared(*pairs(spark, sf_dir)).withColumn("run", F.col("id") % 5)
    runs = each.groupBy("run").agg(F.avg("cosine").alias("cosine"), F.avg("mae").alias("mae")).select("run", F.expr("stack(2, 'cosine', cosine, 'mae', mae) AS (metric, value)"))
    return agreement.worst_of_runs(runs).select("metric", F.round("worst", 7).alias("worst"), F.round("mean", 7).alias("mean"))


@query(f"WITH {QUANT} SELECT file AS id, i::INT AS i, v AS left_value, round(w, 12) AS right_value FROM q WHERE file % 3 <> 1")
def j3_matched_outputs(spark, sf_dir):
    """The outputs of a model and of its quantized twin, which has given some files only, matched by file and place."""
    long = lambda df, name: df.select("id", F.posexplode("values").alias("i", name))
    left, right = pairs(spark, sf_dir)
    return long(left, "left_value").join(long(right.where("id % 3 <> 1"), "right_value"), ["id", "i"]).withColumn("right_value", F.round("right_value", 12))


@query("""WITH f(frontend, precomputed, device) AS (VALUES ('librosa', true, false), ('hybrid', false, true), ('raw', false, true), ('mfcc', true, false), ('log_mel', true, false)),
    d AS (SELECT doc_id, ['librosa', 'hybrid', 'raw', 'mfcc', 'log_mel'][doc_id % 5 + 1] AS frontend FROM documents) SELECT doc_id, frontend, precomputed, device FROM d JOIN f USING (frontend)""")
def j4_frontend_metadata(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ["librosa", "hybrid", "raw", "mfcc", "log_mel"])), (F.col("doc_id") % 5).cast("int"))
    return scoring.frontends_of(table(spark, sf_dir, "documents").select("doc_id", name.alias("frontend"))).select("doc_id", "frontend", "precomputed", "device")


KINDS = ["Conv2D", "DepthwiseConv2D", "Dense", "Softmax", "InputLayer", "Lambda", "ReLU", "MaxPooling2D", "LayerNormalization", "Concatenate", "LSTM", "Sigmoid", "UpSampling2D"]
LAYERS = f"""lay AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'audio_frontend_' ELSE 'layer_' END || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '/bias' ELSE '/kernel' END AS name, {KINDS!r}[p_partkey % {len(KINDS)} + 1] AS layer_type,
    p_partkey % 3 <> 0 AS trainable, (p_size % 16 + 1)::BIGINT AS h, (p_size % 8 + 1)::BIGINT AS w, (p_size * 2)::BIGINT AS o, (p_partkey % 3 + 1)::BIGINT AS k, (p_size + 3)::BIGINT AS c FROM part)"""
MACS = "CASE layer_type WHEN 'Conv2D' THEN h * w * o * k * k * c WHEN 'DepthwiseConv2D' THEN h * w * o * k * k WHEN 'Dense' THEN c * o ELSE 0 END::BIGINT"
PARAMS = "CASE layer_type WHEN 'Conv2D' THEN k * k * c * o + o WHEN 'DepthwiseConv2D' THEN k * k * o + o WHEN 'Dense' THEN c * o + o ELSE 0 END::BIGINT"


def layers(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS)).cast("int"))
    name = F.concat(F.when(F.col("p_partkey") % 9 == 0, "audio_frontend_").otherwise("layer_"), "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "/bias").otherwise("/kernel"))
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), kind.alias("layer_type"), (F.col("p_partkey") % 3 != 0).alias("trainable"), (size % 16 + 1).alias("h"), (size % 8 + 1).alias("w"), (size * 2).alias("o"), (F.col("p_partkey") % 3 + 1).alias("k"), (size + 3).alias("c")
    )


def profiled(spark, sf_dir):
    return layers(spark, sf_dir).select(
        "id", "name", "layer_type", agreement.macs(*map(F.col, ("layer_type", "h", "w", "o", "k", "c"))).alias("macs"), agreement.params(*map(F.col, ("layer_type", "o", "k", "c"))).alias("params"), (F.col("h") * F.col("w") * F.col("o") * 4).alias("activation_bytes")
    )


@query(f"WITH {LAYERS} SELECT name, layer_type, CASE WHEN layer_type = 'UpSampling2D' THEN 'unsupported' ELSE 'care' END AS status FROM lay WHERE layer_type IN ('Lambda', 'LayerNormalization', 'LSTM', 'UpSampling2D')")
def f11_unsupported_layers(spark, sf_dir):
    return agreement.unsupported_layers(layers(spark, sf_dir))


@query(f"WITH {LAYERS} SELECT id, name FROM lay WHERE layer_type IN ('Conv2D', 'DepthwiseConv2D', 'Dense') AND trainable AND name NOT LIKE 'audio\\_frontend%' ESCAPE '\\' AND name NOT LIKE '%/bias'")
def f12_quantizable_weights(spark, sf_dir):
    return agreement.quantizable_weights(layers(spark, sf_dir)).select("id", "name")


@query(f"WITH {LAYERS} SELECT id, name, layer_type, {MACS} AS macs, {PARAMS} AS params, h * w * o * 4 AS activation_bytes FROM lay")
def m28_layer_profile(spark, sf_dir):
    return profiled(spark, sf_dir)


@query(f"""WITH {LAYERS}, p AS (SELECT {MACS} AS m, {PARAMS} AS p, h * w * o * 4 AS a FROM lay)
    SELECT sum(p)::BIGINT AS params, sum(m)::BIGINT AS macs, sum(a)::BIGINT AS activation_bytes, round(sum(p) * 4 / 1024, 3) AS float_kb, round(sum(p) / 1024, 3) AS int8_kb, max(a) AS peak_bytes FROM p""")
def a17_profile_totals(spark, sf_dir):
    return agreement.profile_totals(profiled(spark, sf_dir)).withColumns({c: F.round(c, 3) for c in ("float_kb", "int8_kb")})


@query("""WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL), e AS (SELECT s_nationkey, n, greatest(1, n * (1 + 3) // 2) AS est FROM n)
    SELECT s_nationkey, est AS samples, greatest(1, ceil(est / 32))::BIGINT AS steps FROM e""")
def a19_steps_per_epoch(spark, sf_dir):
    """Samples and batches an epoch of n files with up to three chunks each makes."""
    n = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    samples = arrays.samples_per_epoch(F.col("n"), 3)
    return n.select("s_nationkey", samples.alias("samples"), arrays.steps_per_epoch(samples, 32).alias("steps"))


@query(f"WITH {LAYERS} SELECT id, round({PARAMS} * 4 / greatest({PARAMS}, 1), 6) AS ratio FROM lay")
def a20_compression_ratio(spark, sf_dir):
    return profiled(spark, sf_dir).select("id", F.round(F.col("params") * 4 / F.greatest("params", F.lit(1)), 6).alias("ratio"))


@query("""WITH t AS (SELECT user_id AS trial, max(value) AS best FROM events GROUP BY user_id) SELECT trial, best, '{"dropout":' || trial % 5 || '}' AS params FROM t ORDER BY best DESC, trial LIMIT 1""")
def a22_best_trial(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial"), F.col("value").alias("val_roc_auc"), F.to_json(F.struct((F.col("user_id") % 5).alias("dropout"))).alias("params"))
    return training.best_trial(rows)


@query("SELECT doc_id, greatest(1, n_chars // 256)::INT AS hop FROM documents")
def m22_hop_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", arrays.hop_length(F.col("n_chars"), 256).alias("hop"))


@query("SELECT p_partkey, greatest(8, (p_size + 4) // 8 * 8)::INT AS channels FROM part")
def m23_divisible(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", arrays.divisible(F.col("p_size")).alias("channels"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN '257x256x1' WHEN 2 THEN n_chars || 'x1' WHEN 3 THEN '20x256x1' ELSE '64x256x1' END AS shape FROM documents")
def m29_input_shape(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ["librosa", "hybrid", "raw", "mfcc", "log_mel"])), (F.col("doc_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("frontend"), "n_chars")
    return rows.select("doc_id", arrays.input_shape(F.col("frontend"), F.col("n_chars"), 64, 256, 512).alias("shape"))


@query("""WITH s AS (SELECT doc_id, n_chars AS n, ceil(n_chars / 128)::INT AS stride FROM documents), p AS (SELECT doc_id, stride, greatest(0, stride * 127 + 16 - n) AS pad FROM s)
    SELECT doc_id, stride, (pad // 2)::INT AS pad_left, (pad - pad // 2)::INT AS pad_right FROM p""")
def m30_strided_padding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", arrays.strided_padding(F.col("n_chars"), 128).alias("p")).select("doc_id", "p.*")


@query("""WITH h AS (SELECT doc_id, greatest(128, least(1024, (4 * 1024 * 1024) // greatest(1, (n_chars + 10) * 4))) AS high FROM documents), l AS (SELECT *, greatest(64, high // 3) AS low FROM h)
    SELECT doc_id, high::INT AS high, CASE WHEN low >= high THEN greatest(32, high - 32) ELSE low END::INT AS low FROM l""")
def m31_reservoir_limits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", arrays.reservoir_limits(F.col("n_chars"), 10, 32, 4).alias("r")).select("doc_id", "r.*")


@query("SELECT event_id, round(0.5 * (1 + cos(3.141592653589793 * (event_id % 101) / 100)) * 0.001, 9) AS lr FROM events")
def m32_cosine_decay(spark, sf_dir):
    """The rate at each event's step of 101."""
    return table(spark, sf_dir, "events").select("event_id", F.round(arrays.cosine_decay(F.col("event_id") % 101, 100, 0.001), 9).alias("lr"))


@query("SELECT event_id, round(1e-7 * pow(1e7, (event_id % 200) / 199), 10) AS lr FROM events")
def m33_rate_sweep(spark, sf_dir):
    """The rate at each event's step of 200."""
    return table(spark, sf_dir, "events").select("event_id", F.round(arrays.geometric_sweep(F.col("event_id") % 200, 1e-7, 1.0, 200), 10).alias("lr"))


@query("""WITH r AS (SELECT (vec_id % 10)::INT AS c, CASE WHEN label = vec_id % 10 THEN 1.0 ELSE 0.0 END AS y, (embedding[1]::DOUBLE + 1) / 2 AS p FROM embeddings),
    h AS (SELECT y, least(greatest(r.p, 1e-7), 1 - 1e-7) AS p, 8 * r.p - 4 AS z FROM r), e AS (SELECT *, 1 / (1 + exp(-z)) AS q FROM h)
    SELECT round(avg(pow(1 - (y * p + (1 - y) * (1 - p)), 2) * -(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS focal, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS entropy,
           round(avg(pow(1 - q, 2) * -(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS focal_of_logits FROM e""")
def l1_focal_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") == F.col("vec_id") % 10).cast("double").alias("y"), ((F.get("embedding", F.lit(0)).cast("double") + 1) / 2).alias("p"))
    loss = lambda g: F.round(F.avg(arrays.binary_focal_loss(F.col("y"), F.col("p"), g)), 6)
    of_logits = F.round(F.avg(arrays.binary_focal_loss(F.col("y"), F.col("p") * 8 - 4, from_logits=True)), 6)
    return rows.agg(loss(2.0).alias("focal"), loss(0.0).alias("entropy"), of_logits.alias("focal_of_logits"))


@query(f"""WITH {LONG}, r AS (SELECT file AS id, i, CASE WHEN label = i THEN 1 ELSE 0 END AS y, v * 4 AS s, round_even(v * 8, 0) / 2 AS t FROM smp WHERE i < 10), m AS (SELECT id, max(s) AS ms, max(t) AS mt FROM r GROUP BY id),
    z AS (SELECT id, i, y, s - ms AS s, t - mt AS t FROM r JOIN m USING (id)), n AS (SELECT id, ln(sum(exp(s))) AS z1, ln(sum(exp(s / 3))) AS zs, ln(sum(exp(t / 3))) AS zt FROM z GROUP BY id)
    SELECT id, round(0.5 * sum(-y * (s - z1)) + 0.5 * 9 * sum(exp(t / 3 - zt) * ((t / 3 - zt) - (s / 3 - zs))), 6) AS loss FROM z JOIN n USING (id) GROUP BY id""")
def l3_distillation_loss(spark, sf_dir):
    rows = signals(spark, sf_dir).select(F.col("file").alias("id"), "label", F.posexplode(F.slice("x", 1, 10)).alias("i", "v"))
    given = rows.select("id", (F.col("label") == F.col("i")).cast("int").alias("y"), (F.col("v") * 4).alias("student"), (F.rint(F.col("v") * 8) / 2).alias("teacher"))
    return training.distillation_loss(given).withColumn("loss", F.round("loss", 6))


SERIES = "ser AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value FROM events)"


def series(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), place.alias("step"), "value")


@query(f"""WITH {SERIES}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ser),
    m AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN step END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM b), s AS (SELECT run, min(CASE WHEN step - best >= 10 THEN step END) AS stop FROM m GROUP BY run)
    SELECT m.run, any_value(stop)::INT AS stop, max(best)::INT AS best FROM m JOIN s USING (run) WHERE stop IS NULL OR step <= stop GROUP BY m.run""")
def w15_early_stop(spark, sf_dir):
    return training.early_stop(series(spark, sf_dir), 10, step="step", loss="value")


@query(f"""WITH {SERIES}, m AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS least FROM ser)
    SELECT run, min(CASE WHEN step > 10 AND value > 4 * least THEN step END)::INT AS stop FROM m GROUP BY run""")
def w16_loss_explosion(spark, sf_dir):
    return training.exploded(series(spark, sf_dir), loss="value")


@query(f"""WITH {SERIES}, h AS (SELECT run, step, 1e-7 * pow(1e7, step / 199) AS lr, value, count(*) OVER (PARTITION BY run) AS n FROM ser),
    y AS (SELECT run, n, step AS i, avg(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS y FROM h),
    s AS (SELECT y.run, y.i, y.y, log10(h.lr) AS x, h.lr FROM y JOIN h ON h.run = y.run AND h.step = y.i WHERE y.i <= y.n - 5),
    d AS (SELECT *, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, lag(y) OVER w AS y0, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY run ORDER BY i)),
    g AS (SELECT run, i, lr, CASE WHEN a IS NULL THEN (y2 - y) / b WHEN b IS NULL THEN (y - y0) / a ELSE (a * a * y2 + (b * b - a * a) * y - b * b * y0) / (a * b * (a + b)) END AS g FROM d),
    t AS (SELECT run, lr, row_number() OVER (PARTITION BY run ORDER BY g, i) AS k FROM g), m AS (SELECT run, max(n) AS n, max(CASE WHEN step = n // 2 THEN lr END) AS middle FROM h GROUP BY run)
    SELECT m.run, round(log10(CASE WHEN n < 7 THEN middle ELSE t.lr END), 6) AS log_lr FROM m LEFT JOIN t ON t.run = m.run AND k = 1""")
def w14_suggested_rate(spark, sf_dir):
    """Each user's values as the losses of a sweep of rates."""
    rows = series(spark, sf_dir).select("run", "step", arrays.geometric_sweep(F.col("step"), 1e-7, 1.0, 200).alias("lr"), F.col("value").alias("loss"))
    return training.suggested_rate(rows).select("run", F.round(F.log10("lr"), 6).alias("log_lr"))


@query(f"""WITH {LONG}, w AS (SELECT c.c, i, ((i * 7 + c.c * 3) % 11 - 5) / 8 AS w FROM (SELECT unnest(range(0, 64)) AS i) q, (SELECT unnest(range(0, 10)) AS c) c)
    SELECT file, c::INT AS class, round(1 / (1 + exp(-(sum(v * w) + any_value(c) / 10))), 6) AS score FROM smp JOIN w USING (i) GROUP BY file, c""")
def x1_model_scores(spark, sf_dir):
    """Batched scores of a registered model."""
    i, c = np.arange(64)[:, None], np.arange(10)[None, :]
    scoring.MODELS["linear probe"] = scoring.linear(((i * 7 + c * 3) % 11 - 5) / 8, np.arange(10) / 10)
    done = scoring.scored(signals(spark, sf_dir).select("file", "x"), "linear probe", "x", 64)
    return done.select("file", F.posexplode("scores").alias("class", "score")).withColumn("score", F.round("score", 6))
