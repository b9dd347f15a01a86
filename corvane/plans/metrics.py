"""Pooling, ranking metrics, thresholds and reports over scored recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import bootstrap, pooling, ranking, reports
from corvane.plans.facts import CHUNKED, CLASSES, LARGE, SCORED, chunked, large, scored
from corvane.plans.registry import query, table

# Tie-grouped running sums per class, in SQL.
STEPS = """t AS (SELECT class, s, sum(y)::BIGINT AS tp, count(*) AS n FROM {fact} GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER p AS tp_all, sum(n) OVER p AS n_all FROM t
      WINDOW w AS (PARTITION BY class ORDER BY s DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY class))"""
# The same over all rows.
MICRO = """t AS (SELECT s, sum(y)::BIGINT AS tp, count(*) AS n FROM {fact} GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS tp_all, sum(n) OVER () AS n_all FROM t
      WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
AP = "coalesce(sum(tp / nullif(tp_all, 0) * (ctp / cn)), 0)"
BY_CLASS, ALL = STEPS.format(fact="scored"), MICRO.format(fact="scored")


@query(f"""
    WITH train AS (SELECT label, j.i, avg(embedding[j.i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) j WHERE vec_id % 5 <> 0 GROUP BY ALL),
    x AS (SELECT vec_id, label, j.i, embedding[j.i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) j),
    d AS (SELECT vec_id, x.label, train.label AS class, sum(v * m) AS dot, sqrt(sum(v * v)) AS nv, sqrt(sum(m * m)) AS nm FROM x JOIN train USING (i) GROUP BY ALL),
    c AS (SELECT vec_id, label, class, round((1 + dot / (nv * nm)) / 2, 6) AS score FROM d),
    g AS (SELECT label, vec_id // 3 AS part, class, score * 10 AS b FROM c),
    m AS (SELECT label, part, class, max(b) AS top FROM g GROUP BY ALL),
    pooled AS (SELECT label, part, class, round((any_value(top) + ln(avg(exp(b - top)) + 1e-12)) / 10, 5) AS s FROM g JOIN m USING (label, part, class) GROUP BY ALL),
    fact AS (SELECT class, CASE WHEN class = label THEN 1 ELSE 0 END AS y, s FROM pooled),
    {STEPS.format(fact="fact")}
    SELECT class, round({AP}, 6) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY class
""")
def flagship_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by likeness to class centroids, pooled over recordings (the vectors of a label among three ids), to average precision per class."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    long = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", "i", F.col("x").cast("double").alias("v"))
    centroids = long.where("vec_id % 5 <> 0").groupBy("label", "i").agg(F.avg("v").alias("m"))
    # The centroids are one row (classes x dimensions), whatever the number of vectors.
    packed = centroids.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).select(F.col("label").alias("class"), "m")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding").cast("array<double>")
    scores = vectors.join(F.broadcast(packed)).select("vec_id", "label", "class", F.round((1 + dot(v, F.col("m")) / (F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("m"), F.col("m"))))) / 2, 6).alias("score"))
    pooled = pooling.pool(scores.withColumn("part", F.floor(F.col("vec_id") / 3)), ["label", "part", "class"], "lme")
    fact = pooled.select("class", (F.col("class") == F.col("label")).cast("int").alias("y"), F.round("score", 5).alias("s"))
    return ranking.average_precision(fact, ["class"]).withColumn("ap", F.round("ap", 6))


@query(f"WITH {CHUNKED} SELECT file, class, avg(score) AS score FROM chunked GROUP BY ALL")
def a2_pool_average(spark, sf_dir):
    return pooling.pool(chunked(spark, sf_dir), ["file", "class"], "mean")


@query(f"WITH {CHUNKED} SELECT file, class, max(score) AS score FROM chunked GROUP BY ALL")
def a3_pool_max(spark, sf_dir):
    return pooling.pool(chunked(spark, sf_dir), ["file", "class"], "MAX")


@query(f"""
    WITH {CHUNKED}, m AS (SELECT file, class, max(10 * score) AS top FROM chunked GROUP BY ALL)
    SELECT file, class, round((any_value(top) + ln(avg(exp(10 * score - top)) + 1e-12)) / 10, 5) AS score FROM chunked JOIN m USING (file, class) GROUP BY ALL
""")
def a4_pool_log_mean_exp(spark, sf_dir):
    return pooling.pool(chunked(spark, sf_dir), ["file", "class"], "log_mean_exp").withColumn("score", F.round("score", 5))


@query(f"""
    WITH {CHUNKED}, p AS (SELECT file, class, avg(score) AS a, max(score) AS m FROM chunked GROUP BY ALL)
    SELECT file, list(a ORDER BY class)[1:3]::VARCHAR AS average, list(m ORDER BY class)[1:3]::VARCHAR AS top FROM p GROUP BY file
""")
def a5_pool_matrix(spark, sf_dir):
    """Pooling of whole score matrices, by any of the ways' names."""
    rows = chunked(spark, sf_dir).groupBy("file", "chunk_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "score"))), lambda x: x["score"]).alias("row"))
    matrices = rows.groupBy("file").agg(F.collect_list("row").alias("rows"))
    shown = lambda way: F.concat(F.lit("["), F.array_join(F.slice(pooling.pool_matrix(F.col("rows"), CLASSES, way), 1, 3), ", "), F.lit("]"))
    return matrices.select("file", shown("avg").alias("average"), shown("max").alias("top"))


@query(f"""
    WITH {CHUNKED}, m AS (SELECT file, class, max(score) AS top FROM chunked GROUP BY ALL)
    SELECT file, class, round(sum(exp(score - top) * chunk_idx) / sum(exp(score - top)), 6) AS value FROM chunked JOIN m USING (file, class) GROUP BY ALL
""")
def a23_attention_pooling(spark, sf_dir):
    items = chunked(spark, sf_dir).withColumnRenamed("chunk_idx", "value")
    return pooling.attention(items, ["file", "class"]).withColumn("value", F.round("value", 6))


@query(f"WITH {SCORED}, {BY_CLASS} SELECT class, round({AP}, 6) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY class")
def w1_average_precision(spark, sf_dir):
    return ranking.average_precision(scored(spark, sf_dir), ["class"]).withColumn("ap", F.round("ap", 6))


@query(f"WITH {LARGE}, {STEPS.format(fact='large')} SELECT class, round({AP}, 6) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY class")
def w1_average_precision_large(spark, sf_dir):
    return ranking.average_precision(large(spark, sf_dir), ["class"]).withColumn("ap", F.round("ap", 6))


@query(f"WITH {SCORED}, {ALL} SELECT round({AP}, 6) AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r")
def w2_micro_average_precision(spark, sf_dir):
    return ranking.average_precision(scored(spark, sf_dir)).withColumn("ap", F.round("ap", 6))


AUC = "sum(tp::DOUBLE * (2 * ((n_all - tp_all) - (cn - ctp)) + (n - tp))) / (2 * max(tp_all)::DOUBLE * (max(n_all) - max(tp_all)))"


@query(f"WITH {SCORED}, {ALL} SELECT round({AUC}, 6) AS auc FROM r")
def w3_roc_auc_micro(spark, sf_dir):
    return ranking.roc_auc(scored(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(f"WITH {LARGE}, {MICRO.format(fact='large')} SELECT round({AUC}, 6) AS auc FROM r")
def w3_roc_auc_micro_large(spark, sf_dir):
    return ranking.roc_auc(large(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(f"WITH {SCORED}, {BY_CLASS} SELECT class, round({AUC}, 6) AS auc FROM r GROUP BY class")
def w3_roc_auc_by_class(spark, sf_dir):
    return ranking.roc_auc(scored(spark, sf_dir), ["class"]).withColumn("auc", F.round("auc", 6))


@query(f"""
    WITH {SCORED}, {BY_CLASS}, f AS (
        SELECT class, s, tp_all, coalesce(2 * (ctp / cn) * (ctp / nullif(tp_all, 0)) / (ctp / cn + ctp / nullif(tp_all, 0) + 1e-12), 0) AS f1 FROM r),
    b AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, s) AS k FROM f)
    SELECT class, CASE WHEN tp_all > 0 THEN s ELSE 0.5 END AS threshold, round(f1, 6) AS f1 FROM b WHERE k = 1
""")
def w4_best_thresholds(spark, sf_dir):
    return ranking.best_thresholds(scored(spark, sf_dir), ["class"]).withColumn("f1", F.round("f1", 6))


@query(f"WITH {SCORED}, {ALL} SELECT s AS threshold, round((cn - ctp) / (n_all - tp_all), 6) AS far, round((tp_all - ctp) / tp_all, 6) AS frr FROM r")
def w5_det_curve(spark, sf_dir):
    return ranking.det_curve(scored(spark, sf_dir)).select("threshold", F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


# 20 resamples by integer arithmetic both engines share: a row's weight is a Poisson number of mean 1, by where its draw falls among sums of exp(-1) / k!.
DRAWN = """k AS (SELECT class, file, y, s, b, ((file % 2147483647 + 1) * 1103515245 + (b + 1) * 12345) % 2147483647 AS d FROM scored, (SELECT unnest(range(0, 20)) AS b) q),
d1 AS (SELECT *, (d * d + (b + 1) * 69621) % 2147483647 AS e FROM k), d2 AS (SELECT *, (e * e + file % 2147483647 + 1) % 2147483647 AS f FROM d1), d3 AS (SELECT *, (f * f + (b + 1) * 40503) % 2147483647 AS g FROM d2),
pw AS (SELECT j, floor(2147483647 * sum(exp(-1.0::DOUBLE) / factorial(j)) OVER (ORDER BY j)) AS edge FROM (SELECT unnest(range(0, 12))::INT AS j) q),
z AS (SELECT class, b, y, s, (SELECT count(*) FROM pw WHERE g >= edge) AS w FROM d3),
t AS (SELECT class, b, s, sum(y * w)::BIGINT AS tp, sum(w)::BIGINT AS n FROM z WHERE w > 0 GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER p AS tp_all, sum(n) OVER p AS n_all FROM t
      WINDOW w AS (PARTITION BY class, b ORDER BY s DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY class, b)),
a AS (SELECT class, b, sum(tp / tp_all * (ctp / cn)) AS ap FROM r WHERE tp_all > 0 AND tp_all < n_all GROUP BY ALL)"""


@query(f"""
    WITH {SCORED}, {DRAWN}
    SELECT class, round(quantile_cont(ap, 0.025), 6) AS ci_lower, round(quantile_cont(ap, 0.975), 6) AS ci_upper FROM a GROUP BY class
""")
def w6_bootstrap_intervals(spark, sf_dir):
    found = bootstrap.intervals(scored(spark, sf_dir), "class", "file", resamples=20)
    return found.select("class", F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"))


@query(f"""
    WITH {SCORED}, {ALL}, p AS (SELECT ctp / cn AS precision, coalesce(ctp / nullif(tp_all, 0), 0) AS recall FROM r),
    b AS (SELECT unnest(range(0, 10)) AS band)
    SELECT band::INT AS band, round(coalesce(max(recall), 0), 6) AS recall FROM b LEFT JOIN p ON precision BETWEEN band / 10 AND (band + 1) / 10 GROUP BY band
""")
def w7_precision_bands(spark, sf_dir):
    return reports.precision_bands(ranking.precision_recall_points(scored(spark, sf_dir))).select("band", F.round("recall", 6).alias("recall"))


@query(f"""
    WITH {SCORED}, {ALL}, p AS (SELECT (cn - ctp) / (n_all - tp_all) AS far, (tp_all - ctp) / tp_all AS frr FROM r),
    b AS (SELECT unnest(range(0, 10)) AS band)
    SELECT band::INT AS band, round(coalesce(min(far), 1), 6) AS far FROM b LEFT JOIN p ON frr >= band / 10 AND frr < (band + 1) / 10 GROUP BY band
""")
def w8_det_bands(spark, sf_dir):
    return reports.det_bands(ranking.det_curve(scored(spark, sf_dir))).select("band", F.round("far", 6).alias("far"))


@query(f"""
    WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, class) AS rank FROM scored)
    SELECT file, class, y, s FROM k WHERE rank = 1
""")
def w9_top_class(spark, sf_dir):
    return ranking.top_classes(scored(spark, sf_dir)).select("file", "class", "y", "s")


@query(f"""
    WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, class) AS rank FROM scored)
    SELECT file, rank::INT AS rank, class, (floor(s * 1000) / 10)::DOUBLE AS percent FROM k WHERE rank <= 3 AND s >= 0.5
""")
def w10_device_top_k(spark, sf_dir):
    return reports.device_lines(scored(spark, sf_dir), k=3, threshold=0.5).select("file", "rank", "class", "percent")


@query(f"""
    WITH {SCORED}, {BY_CLASS}, a AS (SELECT class, {AP} AS ap FROM r GROUP BY class),
    k AS (SELECT 'top' AS side, row_number() OVER (ORDER BY ap DESC, class) AS rank, class, ap FROM a UNION ALL SELECT 'bottom', row_number() OVER (ORDER BY ap, class DESC), class, ap FROM a)
    SELECT side, rank::INT AS rank, class, round(ap, 6) AS ap FROM k WHERE rank <= 3
""")
def w11_best_and_worst_classes(spark, sf_dir):
    return ranking.ends(ranking.average_precision(scored(spark, sf_dir), ["class"]), 3).withColumn("ap", F.round("ap", 6))


@query(f"""
    WITH {SCORED}, c AS (SELECT sum(CASE WHEN s >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) AS pp, sum(y) AS p FROM scored),
    q AS (SELECT tp / (pp + 1e-12) AS precision, tp / (p + 1e-12) AS recall FROM c)
    SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM q
""")
def a9_micro_precision_recall(spark, sf_dir):
    return ranking.micro_scores(scored(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


MATRIX = """o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, class) AS k FROM scored),
g AS (SELECT file, max(CASE WHEN k = 1 THEN CASE WHEN s < 0.55 THEN -1 ELSE class END END) AS pred, max(CASE WHEN y = 1 THEN class END) AS "true" FROM o GROUP BY file),
x AS (SELECT "true", pred, count(*) AS n FROM g WHERE "true" IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {SCORED}, {MATRIX} SELECT \"true\"::INT AS \"true\", pred::INT AS pred, n FROM x")
def a10_confusion_matrix(spark, sf_dir):
    return ranking.confusion(scored(spark, sf_dir), 0.55)


@query(f"WITH {SCORED}, {MATRIX} SELECT round(sum(CASE WHEN \"true\" = pred THEN n ELSE 0 END) / greatest(sum(n), 1), 6) AS accuracy FROM x WHERE pred >= 0")
def a11_accuracy(spark, sf_dir):
    return ranking.accuracy(ranking.confusion(scored(spark, sf_dir), 0.55)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
    WITH {SCORED}, b AS (SELECT unnest(range(0, 10)) AS bin)
    SELECT bin::INT AS bin, count(s) AS n FROM b LEFT JOIN scored ON s BETWEEN 0 AND 1 AND least(floor(s * 10), 9) = bin GROUP BY bin
""")
def a12_histogram(spark, sf_dir):
    return reports.histogram(scored(spark, sf_dir), "s")


@query("""
    WITH v AS (SELECT user_id % 5 AS device, value FROM events)
    SELECT device, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM v GROUP BY device
""")
def a8_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("device"), "value")
    return reports.latency(rows, "value", ["device"]).select("device", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99")), "n")


@query(f"WITH {SCORED}, {BY_CLASS}, a AS (SELECT class, {AP} AS ap FROM r GROUP BY class) SELECT round(avg(ap), 6) AS cmap FROM a")
def a18_class_mean_precision(spark, sf_dir):
    per_class = ranking.average_precision(scored(spark, sf_dir), ["class"])
    return ranking.mean_average_precision(per_class).withColumn("cmap", F.round("cmap", 6))


@query(f"""
    WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY s DESC, class) AS k FROM scored),
    w AS (SELECT file, class, printf('%.3f', s) AS s, k, y FROM k)
    SELECT file, max(CASE WHEN y = 1 THEN class END) AS label, max(CASE WHEN k = 1 THEN class END) AS top1_label, max(CASE WHEN k = 1 THEN s END) AS top1_score,
           {", ".join(f"max(CASE WHEN class = {c} THEN s END) AS c{c}" for c in range(10))} FROM w GROUP BY file
""")
def s12_predictions(spark, sf_dir):
    return reports.predictions(scored(spark, sf_dir), list(range(CLASSES)))


@query(f"""
    WITH {SCORED}, {BY_CLASS}, {DRAWN.replace("t AS (", "t2 AS (").replace("FROM t\n", "FROM t2\n").replace("r AS (", "r2 AS (").replace("FROM r WHERE", "FROM r2 WHERE")},
    p AS (SELECT class, {AP} AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r GROUP BY class),
    c AS (SELECT class, quantile_cont(ap, 0.025) AS lo, quantile_cont(ap, 0.975) AS hi FROM a GROUP BY class)
    SELECT class, round(ap, 6) AS ap, round(coalesce(lo, ap), 6) AS ci_lower, round(coalesce(hi, ap), 6) AS ci_upper, n_positive, n_total FROM p LEFT JOIN c USING (class)
""")
def s13_species_report(spark, sf_dir):
    return reports.species_report(scored(spark, sf_dir), "class", "file", resamples=20)


@query(f"""
    WITH {SCORED}, {ALL}, c AS (SELECT sum(CASE WHEN s >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END) AS pp, sum(y) AS p FROM scored),
    q AS (SELECT tp / (pp + 1e-12) AS pr, tp / (p + 1e-12) AS re FROM c), u AS (SELECT {AUC} AS auc, {AP} AS ap FROM r),
    {STEPS.format(fact='scored').replace("t AS (", "t3 AS (").replace("FROM t\n", "FROM t3\n").replace("r AS (", "r3 AS (")},
    pc AS (SELECT class, {AP} AS ap, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_total FROM r3 GROUP BY class),
    sp AS (SELECT string_agg('{{"class":' || class || ',"ap":' || printf('%.6f', ap) || ',"ci_lower":' || printf('%.6f', ap) || ',"ci_upper":' || printf('%.6f', ap) || ',"n_positive":' || n_positive || ',"n_total":' || n_total || '}}', ',' ORDER BY ap DESC, class) AS species FROM pc)
    SELECT '{{"model_path":"models/m1","num_classes":10,"num_files":' || (SELECT count(DISTINCT file) FROM scored) || ',"metrics":{{"f1":' || printf('%.6f', CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) || ',"map":' || printf('%.6f', ap) || ',"precision":' || printf('%.6f', pr)
           || ',"recall":' || printf('%.6f', re) || ',"roc_auc":' || printf('%.6f', auc) || '}},"species":[' || sp.species || '],"config":{{"fft_length":512}}}}' AS json FROM q, u, sp
""")
def s14_benchmark_json(spark, sf_dir):
    species = ranking.average_precision(scored(spark, sf_dir), ["class"]).withColumns({c: F.col("ap") for c in ("ci_lower", "ci_upper")})
    return reports.benchmark_json(scored(spark, sf_dir), CLASSES, "models/m1", species, '{"fft_length":512}')


@query(f"""
    WITH {SCORED}, b AS (SELECT unnest(range(0, 10)) AS bin), h AS (SELECT bin, count(s) AS n FROM b LEFT JOIN scored ON s BETWEEN 0 AND 1 AND least(floor(s * 10), 9) = bin GROUP BY bin)
    SELECT bin::INT AS bin, repeat('#', (40 * n // max(n) OVER ())::INT) AS bar FROM h
""")
def t4_bars(spark, sf_dir):
    return reports.bars(reports.histogram(scored(spark, sf_dir), "s"), "n").select("bin", "bar")
