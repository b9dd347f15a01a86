"""Exact values and degenerate inputs of operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import arrays, spectral
from corvane.operators import agreement, bootstrap, catalog, pooling, ranking, reports, salience, scoring, telemetry, training


def one(spark, **columns):
    """The values of column expressions over a single row."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def arr(*values):
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def scores(spark, y, s, cls="a"):
    return spark.createDataFrame([(i, cls, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "file long, class string, y int, s double")


def close(a, b, by=1e-6):
    return all(abs(x - y) <= by for x, y in zip(a, b, strict=True))


def test_pooling(spark):
    rows = F.array(arr(0.2, 0.8), arr(0.6, 0.4))
    got = one(spark, avg=pooling.pool_matrix(rows, 2, "Mean"), top=pooling.pool_matrix(rows, 2, "max"), none=pooling.pool_matrix(F.array().cast("array<array<double>>"), 5))
    assert close(got["avg"], [0.4, 0.6]) and close(got["top"], [0.6, 0.8]) and got["none"] == [0.0] * 5
    got = one(spark, same=pooling.pool_matrix(F.array(arr(0.5, 0.3)), 2, "lme"), sharp=pooling.pool_matrix(F.array(arr(0.1, 0.9), arr(0.8, 0.2)), 2, "lme", 100.0))
    assert close(got["same"], [0.5, 0.3], 1e-5) and close(got["sharp"], [0.8, 0.9], 0.05)
    with pytest.raises(ValueError):
        pooling.pool_matrix(rows, 2, "median")


def test_likeness(spark):
    got = one(
        spark, same=arrays.cosine(arr(1, 2), arr(1, 2)), against=arrays.cosine(arr(1, 2), arr(-1, -2)), apart=arrays.cosine(arr(1, 0), arr(0, 1)), zeros=arrays.cosine(arr(0, 0), arr(0, 0)), zero=arrays.cosine(arr(0, 0), arr(1, 1)),
        up=arrays.pearson(arr(1, 2, 3), arr(2, 4, 6)), down=arrays.pearson(arr(1, 2, 3), arr(3, 2, 1)), flat=arrays.pearson(arr(1, 1), arr(1, 2)),
    )
    assert close([got[k] for k in ("same", "against", "apart", "zeros", "zero", "up", "down", "flat")], [1, -1, 0, 1, 0, 1, -1, 1])


def test_arrays(spark):
    got = one(
        spark, constant=arrays.min_max(arr(3, 3)), quantized=arrays.fake_quantized(arr(2, 2)), zero=arrays.fake_quantized(arr(0, 0)), padded=arrays.fitted(arr(1, 2), 4), cut=arrays.fitted(arr(1, 2, 3), 2),
        silence=arrays.peak_normalized(arr(0, 0)), counts=F.array(*(arrays.n_chunks(F.lit(n), 10, 7) for n in (0, 5, 10, 17, 20))), starts=arrays.chunk_starts(F.lit(20), 10, 7),
        eights=F.array(*(arrays.divisible(F.lit(v)) for v in (32.0, 30.0, 28.0, 1.0, 0.0, 33.5))),
    )
    assert got["constant"] == [0, 0] and close(got["quantized"], [2, 2]) and close(got["zero"], [0, 0])
    assert got["padded"] == [1, 2, 0, 0] and got["cut"] == [1, 2] and got["silence"] == [0, 0]
    assert got["counts"] == [0, 1, 1, 2, 3] and got["starts"] == [0, 7, 10]
    assert got["eights"] == [32, 32, 32, 8, 8, 32]


def test_epochs_and_losses(spark):
    got = one(
        spark, a=arrays.samples_per_epoch(F.lit(100), 1), b=arrays.samples_per_epoch(F.lit(100), 3), c=arrays.samples_per_epoch(F.lit(0), 3), steps=arrays.steps_per_epoch(F.lit(100), 32),
        plain=arrays.binary_focal_loss(F.lit(1.0), F.lit(0.3), 0.0), focal=arrays.binary_focal_loss(F.lit(1.0), F.lit(0.3), 2.0), held=arrays.binary_focal_loss(F.lit(1.0), F.lit(0.0), 0.0),
        top=pooling.pool_matrix(F.array(arr(0.1, 0.9), arr(0.7, 0.3)), 2, "max"),
    )
    assert (got["a"], got["b"], got["c"], got["steps"]) == (100, 200, 1, 4) and got["top"] == [0.7, 0.9]
    assert abs(got["plain"] + math.log(0.3)) < 1e-9 and abs(got["focal"] + 0.49 * math.log(0.3)) < 1e-9 and abs(got["held"] + math.log(1e-7)) < 1e-6


def test_activity(spark):
    loud = [0.01] * 90 + [1.0] * 10
    got = one(spark, silence=salience.activity_ratio(arr(*[0] * 20)), constant=salience.activity_ratio(arr(*[0.5] * 20)), some=salience.activity_ratio(arr(*loud)), none=salience.activity_ratio(arr()))
    assert (got["silence"], got["constant"], got["none"]) == (0, 0, 0) and abs(got["some"] - 0.1) < 1e-9


def test_crops_find_the_loud_parts(spark):
    x = np.random.default_rng(3).normal(0, 0.01, 4096)
    x[1000:1100], x[3000:3100] = 1.0, 0.5
    df = spark.createDataFrame([(x.tolist(),), ([0.1] * 10,)], "x array<double>")
    found = [r[0] for r in df.select(salience.crops(F.col("x"), 512, 2)).collect()]
    assert len(found[0]) == 2 and abs(found[0][0] - 800) < 200 and abs(found[0][1] - 2800) < 200 and found[1] == [0]


def brute_ap(y, s):
    ap = last = 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = sum(a for a, b in zip(y, s, strict=True) if b >= t), sum(b >= t for b in s)
        ap, last = ap + (tp / sum(y) - last) * tp / n, tp / sum(y)
    return ap


def brute_auc(y, s):
    pairs = [(p, q) for a, p in zip(y, s, strict=True) if a for b, q in zip(y, s, strict=True) if not b]
    return sum((p > q) + 0.5 * (p == q) for p, q in pairs) / len(pairs)


def test_ranking_against_brute_force(spark):
    draw = np.random.default_rng(1)
    y, s = draw.integers(0, 2, 300).tolist(), (draw.integers(0, 40, 300) / 40).tolist()
    df = scores(spark, y, s)
    assert abs(ranking.average_precision(df).first()["ap"] - brute_ap(y, s)) < 1e-9
    assert abs(ranking.average_precision(df, ["class"]).first()["ap"] - brute_ap(y, s)) < 1e-9
    assert abs(ranking.roc_auc(df).first()["auc"] - brute_auc(y, s)) < 1e-9
    f1 = {t: 2 * tp / (sum(y) + sum(b >= t for b in s)) for t in set(s) for tp in [sum(a for a, b in zip(y, s, strict=True) if b >= t)]}
    best = ranking.best_thresholds(df, ["class"]).first()
    assert abs(best["f1"] - max(f1.values())) < 1e-9 and best["threshold"] == min(t for t in f1 if f1[t] > max(f1.values()) - 1e-12)


def test_ranking_degenerate(spark):
    none, all_ = scores(spark, [0, 0], [0.1, 0.9]), scores(spark, [1, 1], [0.1, 0.9])
    assert ranking.average_precision(none).first()["ap"] == 0 and math.isnan(ranking.roc_auc(none).first()["auc"]) and math.isnan(ranking.roc_auc(all_).first()["auc"])
    assert ranking.best_thresholds(none, ["class"]).first()["threshold"] == 0.5
    assert [tuple(r) for r in ranking.det_curve(none).collect()] == [(0.5, 0.0, 0.0)]
    perfect = ranking.det_curve(scores(spark, [1, 1, 0, 0], [0.9, 0.8, 0.1, 0.2])).collect()
    assert min(r["far"] + r["frr"] for r in perfect) < 0.01
    empty = scores(spark, [], [])
    assert ranking.average_precision(empty, ["class"]).count() == 0 and ranking.micro_scores(none).first()["f1"] == 0
    assert ranking.mean_average_precision(ranking.average_precision(none.union(scores(spark, [1, 0], [0.9, 0.1], "b")), ["class"])).first()[0] == 0.5


def test_bootstrap(spark):
    draw = np.random.default_rng(2)
    y = draw.integers(0, 2, 50)
    df = scores(spark, y.tolist(), (0.8 * y + draw.random(50) * 0.6).tolist()).withColumn("class", F.lit(0))
    point = ranking.average_precision(df, ["class"]).first()["ap"]
    wide, narrow = (bootstrap.intervals(df, "class", "file", 100, c).first() for c in (0.99, 0.9))
    assert wide["ci_lower"] <= point <= wide["ci_upper"] and wide["ci_upper"] - wide["ci_lower"] >= narrow["ci_upper"] - narrow["ci_lower"]
    assert tuple(wide) == tuple(bootstrap.intervals(df, "class", "file", 100, 0.99).first())
    same = reports.species_report(scores(spark, [1, 1], [0.2, 0.4]).withColumn("class", F.lit(0)), "class", "file", 10).first()
    assert same["ci_lower"] == same["ci_upper"] == same["ap"] == 1


def test_reports(spark):
    df = scores(spark, [1, 0, 1], [1.0, 0.05, 1.5])
    bins = {r["bin"]: r["n"] for r in reports.histogram(df, "s").collect()}
    assert bins[9] == 1 and bins[0] == 1 and sum(bins.values()) == 2
    page = reports.html_report("a <b>", {"t": df})
    assert "a &lt;b&gt;" in page and page.count("<tr>") == 4


def test_catalog(spark):
    rows = spark.createDataFrame([(i, f"x/{'big' if i < 100 else 'small'}/{i}.WAV") for i in range(110)] + [(200, "x/Noise/1.mp3"), (201, "x/big/1.txt")], "id long, path string")
    files = catalog.file_catalog(rows)
    classes = catalog.class_names(files)
    assert files.count() == 111 and [r["class"] for r in classes.orderBy("class_idx").collect()] == ["big", "small"]
    up = catalog.upsampled(files, classes, 0.5)
    assert {r["label"]: r["count"] for r in up.groupBy("label").count().collect()} == {"big": 100, "small": 50}
    parts = {r["part"]: r["count"] for r in catalog.split(files, 0.25).groupBy("part").count().collect()}
    assert parts == {"train": 83, "validation": 28}
    weights = {r["class"]: r["weight"] for r in catalog.class_weights(files, classes).collect()}
    assert abs(weights["big"] - 0.55) < 1e-9 and abs(weights["small"] - 5.5) < 1e-9
    assert catalog.split(files.limit(0), 0.5).count() == 0
    with pytest.raises(Exception, match="unknown frontend"):
        spark.range(1).select(catalog.frontend(F.lit("no such"))).collect()


TRANSCRIPT = """[1/2] a.wav
  [WAV] 24000 Hz, 16-bit, 1 ch, 72000 samples
  [BENCH] read=12ms stft=28ms npu=4ms total=44ms
  a.wav:
    [1] first kind: 72.3%
    [2] second kind: 0.1%

[2/2] b.wav
  [BENCH] read=11ms stft=27ms npu=3ms total=41ms
    [1] third kind: 89.1%

=== DONE ===
Processed: 2 / 2 files (0 errors)
Benchmark: read=23ms stft=55ms npu=7ms total=85ms (avg read=11ms stft=27ms npu=3ms total=42ms)"""


def test_telemetry(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(TRANSCRIPT.split("\n"))], "device string, line_no long, line string")
    found = {r["file"]: r for r in telemetry.results(lines).collect()}
    assert [(d["label"], round(d["score"], 3)) for d in found["a.wav"]["detections"]] == [("first kind", 0.723)] and found["b.wav"]["bench"]["total_ms"] == 41
    last = telemetry.totals(lines).first()
    assert (last["processed"], last["errors"], last["avg_total_ms"]) == (2, 0, 42)
    assert telemetry.results(lines.limit(0)).count() == 0


def test_training(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])], "run int, epoch int, val_loss double")
    assert tuple(training.early_stop(rows, 3).first()) == (1, 4, 1)
    assert training.early_stop(rows, 9).first()["stop"] is None
    summary = {r["metric"]: r for r in agreement.agreement_summary(agreement.compared(*[spark.createDataFrame([], "id int, values array<double>")] * 2)).collect()}
    assert summary["cosine"]["mean"] == 0 and math.isinf(summary["mse"]["mean"])


def test_config(tmp_path):
    assert config.ModelConfig.from_json('{"audio_frontend": "tf", "other": 1}').audio_frontend == "raw"
    with pytest.raises(ValueError, match="sample_rate"):
        config.ModelConfig(sample_rate=0)
    path = tmp_path / "c.toml"
    path.write_text('[deploy]\nport = "p1"\n[build]\ntop_k = 3\n')
    got = config.resolve({"port": ""}, str(path), environment={"CORVANE_TIMEOUT": "5"})
    assert (got.port, got.top_k, got.timeout, got.baud) == ("p1", 3, 5.0, 115_200)


def test_registries():
    with pytest.raises(ValueError):
        scoring.register_frontend(scoring.Frontend("raw", False, True))
    scoring.register_model("m")(scoring.linear(np.ones((2, 1)), np.zeros(1)))
    with pytest.raises(ValueError):
        scoring.register_model("m")(None)


def test_spectra():
    x = np.sin(2 * np.pi * np.arange(512) * 8 / 64)
    m = spectral.magnitudes(x[None], 64, 32, spectral.hann(64, False), False, None)[0]
    assert m.shape == (15, 33) and (m.argmax(1) == 8).all()


def test_starts_keep_apart(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.permutation(60)[:20].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s array<int>")
    for i, s, got in df.select("id", "s", salience.apart(F.col("s"), 8, 4)).collect():
        wanted = []
        for x in s:
            if len(wanted) < 4 and all(abs(x - y) >= 8 for y in wanted):
                wanted.append(x)
        assert got == wanted, i


def test_running_sums_without_groups_use_no_single_window(spark):
    """Scores of one range and of many give the sums of a plain sort."""
    draw = np.random.default_rng(8)
    for s in (np.full(50, 0.5), draw.random(3000)):
        y = draw.integers(0, 2, len(s)).tolist()
        found = {r["s"]: (r["ctp"], r["cn"]) for r in ranking.running(ranking.tie_groups(scores(spark, y, s.tolist()), []), []).collect()}
        for t in list(found)[::97]:
            assert found[t] == (sum(a for a, b in zip(y, s, strict=True) if b >= t), int((s >= t).sum()))


def test_mixup_without_chances_changes_nothing(spark):
    from corvane.operators import augment

    rows = spark.createDataFrame([(i, [float(i), 1.0], [1.0, 0.0]) for i in range(5)], "id long, samples array<double>, y array<double>")
    done = augment.mixed(rows, augment.mix_partners(rows, 0.0))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, rows.collect()))
    pair = spark.createDataFrame([(0, 0, 0.75), (0, 1, 0.25)], "id long, partner long, gain double")
    assert augment.mixed(rows, pair).where("id = 0").first()["samples"] == [0.25, 1.0]


def test_training_samples(spark):
    from corvane.operators import evaluation

    draw = np.random.default_rng(9)
    rows = [(i, label, draw.normal(0, 1, n).tolist()) for i, (label, n) in enumerate([("a", 100), ("b", 7), ("noise", 30), ("unknown", 50), ("a", 0)])]
    df = spark.createDataFrame(rows, "file long, label string, samples array<double>")
    classes = spark.createDataFrame([(0, "a"), (1, "b")], "class_idx int, class string")
    found = evaluation.training_samples(df, classes, 10, most=3, threshold=0.9).collect()
    assert {r["file"] for r in found} == {0, 1, 2, 4} and all(len(r["samples"]) == 10 for r in found)
    assert {r["file"]: r["class_idx"] for r in found}[2] is None


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * np.arange(400) / 40)
    y = spectral.resample(x[None], *spectral.polyphase(4, 3))[0]
    assert len(y) == 300 and np.allclose(y[30:-30], np.sin(2 * np.pi * np.arange(300) / 30)[30:-30], atol=0.01)


def test_gain_control_flattens_levels():
    loud, quiet = (spectral.gain_controlled(np.full((1, 50, 3), v * 2.0**31), spectral.smoothing(0.4, 22_050, 512), 0.98, 2.0, 0.5, 1e-6)[0] for v in (0.5, 0.05))
    assert abs(loud[-1][0] - quiet[-1][0]) < 0.2 * loud[-1][0] and all(len(r) == 3 for r in loud)


def test_places_by_ranges_are_those_of_one_window(spark):
    """A hot group, ties and nulls of the first key, a null group, an order that runs down, and no rows."""
    from corvane.operators.numbering import numbered

    draw = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 4}", None if i % 17 == 0 else int(draw.integers(0, 300))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    found = {r["id"]: r["place"] for r in numbered(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    wanted = {}
    for g in {r[1] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0])), 1):
            wanted[r[0]] = place
    assert found == wanted
    down = {r["id"]: r["n"] for r in numbered(df, ["g"], [-F.col("id")], "n").collect()}
    assert down == {r[0]: sum(o[1] == r[1] and o[0] >= r[0] for o in rows) for r in rows}
    assert numbered(df.limit(0), ["g"], [F.col("v")]).count() == 0
