"""Features of all frontends against plain definitions; training and evaluation on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import frontends
from corvane.functions.frontends import Feature
from corvane.operators import evaluation, scoring


def plain(x, f):
    """One signal's feature, frame by frame and band by band."""
    hop = max(1, len(x) // f.width)
    wide = np.pad(x, f.size // 2)
    wide = np.pad(wide, (0, max(0, f.size - len(wide))))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / f.size) for n in range(f.size)]
    mags = np.array([np.abs(np.fft.rfft(wide[a : a + f.size] * window)) for a in range(0, len(wide) - f.size + 1, hop)]).T
    mel = lambda hz: hz * 3 / 200 if hz < 1000 else 15 + math.log(hz / 1000) * 27 / math.log(6.4)
    back = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    low, high = mel(150.0), mel(f.rate / 2)
    edges = [back(low + (high - low) * i / (f.bands + 1)) for i in range(f.bands + 2)]
    bank = np.zeros((f.bands, f.size // 2 + 1))
    for m in range(f.bands):
        a, b, c = edges[m : m + 3]
        for k in range(f.size // 2 + 1):
            hz = k * f.rate / f.size
            bank[m, k] = max(0.0, min((hz - a) / (b - a), (c - hz) / (c - b))) * 2 / (c - a)
    scale = lambda y: (y - y.min()) / (y.max() - y.min() + 1e-10)
    db = lambda p: np.maximum(10 * np.log10(np.maximum(p, 1e-10) / max(p.max(), 1e-10)), -80)
    if f.frontend == "hybrid":
        return scale(mags[:, : f.width])
    if f.frontend == "mfcc":
        p = db(bank @ mags**2)
        dct = np.array([[math.cos(math.pi * k * (2 * i + 1) / (2 * f.bands)) * math.sqrt((1 if k == 0 else 2) / f.bands) for i in range(f.bands)] for k in range(f.coefficients)])
        return scale((dct @ p)[:, : f.width])
    y = (bank @ mags)[:, : f.width]
    if f.frontend == "log_mel":
        return scale(np.log1p(y))
    if f.scale == "pwl":
        y = scale(y)
        y = 0.40 * y + 0.25 * np.maximum(y - 0.10, 0) + 0.15 * np.maximum(y - 0.35, 0) + 0.08 * np.maximum(y - 0.65, 0)
    elif f.scale == "db":
        y = db(y**2)
    elif f.scale == "pcen":
        t = 0.4 * f.rate / hop
        b = (math.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
        m, out = np.ones(f.bands), []
        for frame in y.T * 2**31:
            m = (1 - b) * m + b * frame
            out.append(2**0.5 * ((frame * (1e-6 + m) ** -0.98 / 2 + 1) ** 0.5 - 1))
        y = np.array(out).T
    return scale(y)


CASES = [Feature(n, 24_000, s, 64, 16, 12, 5) for n, s in (("librosa", "none"), ("librosa", "pwl"), ("librosa", "db"), ("librosa", "pcen"), ("log_mel", "none"), ("mfcc", "none"), ("hybrid", "none"))]


@pytest.mark.parametrize("feature", CASES, ids=lambda f: f"{f.frontend}-{f.scale}")
def test_features_are_their_definitions(spark, feature):
    draw = np.random.default_rng(3)
    signals = [draw.normal(0, 0.3, n) for n in (640, 640, 333, 100, 17, 5)] + [np.sin(np.arange(640) / 4), np.zeros(640)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)] + [(90, []), (91, None)], "id int, x array<double>")
    found = {r[0]: r[1] for r in df.repartition(2).select("id", frontends.features(feature)("x")).collect()}
    assert found[91] is None and all(not r for r in found[90])
    for i, x in enumerate(signals):
        wanted = plain(x, feature)
        assert np.array(found[i]).shape == wanted.shape == feature.shape(len(x))
        assert np.allclose(found[i], wanted, atol=1e-6), (i, len(x))


def test_ranges_shapes_and_silence(spark):
    f = Feature("librosa", 24_000, "none", 512, 64, 32)
    x = np.sin(np.arange(24_000) / 3)
    rows = spark.createDataFrame([(0, x.tolist()), (1, [0.0] * 24_000)], "id int, x array<double>").select("id", frontends.features(f)("x").alias("f"), frontends.features(Feature("hybrid", 24_000, size=512, width=64))("x").alias("h")).collect()
    by = {r["id"]: (np.array(r["f"]), np.array(r["h"])) for r in rows}
    assert by[0][0].shape == (32, 64) and by[0][1].shape == (257, 64)
    assert by[0][0].min() >= 0 and abs(by[0][0].max() - 1) < 1e-6 and np.abs(by[1][0]).max() < 1e-3
    for bad in (("other", "none"), ("librosa", "cube")):
        with pytest.raises(ValueError):
            Feature(bad[0], 8_000, bad[1])


@pytest.fixture(scope="module")
def recordings(spark):
    """Noise with a burst, of two known classes, an unknown one, and noise files."""
    draw = np.random.default_rng(5)
    rows = []
    for i in range(24):
        x = draw.normal(0, 0.01, 1600)
        x[400 + 30 * i : 480 + 30 * i] += np.sin(np.arange(80))
        rows.append((i, ["a", "b", "zz", "noise"][i % 4], x.tolist()))
    rows.append((99, "a", []))
    return spark.createDataFrame(rows, "file long, label string, samples array<double>"), spark.createDataFrame([(0, "a"), (1, "b")], "class_idx int, class string")


def activity(x):
    flat = np.abs(x).ravel()
    picked = flat[np.linspace(0, flat.size - 1, 512, dtype=int)] if flat.size > 512 else flat
    m = np.median(picked)
    r = np.mean(np.abs(x) > m + 2 * (np.median(np.abs(picked - m)) + 1e-10))
    return 0.0 if r > 0.8 else r


@pytest.mark.parametrize("feature", [CASES[1], CASES[3], CASES[5], CASES[6]], ids=lambda f: f"{f.frontend}-{f.scale}")
def test_the_features_activity_decides(spark, recordings, feature):
    signals, classes = recordings
    found = evaluation.training_features(signals, classes, feature, 200, most=2, threshold=0.05).collect()
    chunks = {(r["file"], r["chunk_idx"]): r for r in evaluation.candidate_chunks(signals, classes, 200, 2).collect()}
    assert {r["file"] for r in found} == {f for f, _ in chunks} and not any(f % 4 == 2 for f, _ in chunks)
    for file in {f for f, _ in chunks}:
        own = {c: plain(np.array(r["samples"]), feature) for (f, c), r in chunks.items() if f == file}
        order = sorted(own, key=lambda c: (-round(activity(own[c]), 9), -c))
        wanted = [c for i, c in enumerate(order) if i == 0 or activity(own[c]) >= 0.05][:2]
        kept = [r for r in found if r["file"] == file]
        assert sorted(r["chunk_idx"] for r in kept) == sorted(wanted)
        assert all(np.allclose(r["feature"], own[r["chunk_idx"]], atol=1e-6) for r in kept)
        assert all((r["class_idx"] is None) == (file == 99 or file % 4 == 3) for r in kept)


def test_masks_zero_stretches_of_kept_features_only(spark, recordings):
    signals, classes = recordings
    f = CASES[0]
    plain_rows, masked, again = (
        {(r["file"], r["chunk_idx"]): np.array(r["feature"]) for r in evaluation.training_features(signals, classes, f, 200, most=2, masks=m).collect()} for m in (None, (4, 5, 2), (4, 5, 2))
    )
    assert plain_rows.keys() == masked.keys() and any((plain_rows[k] != masked[k]).any() for k in masked)
    for k, x in masked.items():
        assert (x == again[k]).all() and ((x == plain_rows[k]) | (x == 0)).all()
        changed = x != plain_rows[k]
        whole_rows, whole_frames = (x == 0).all(1), (x == 0).all(0)
        assert (changed <= (whole_rows[:, None] | whole_frames[None, :])).all()
        assert whole_rows.sum() <= 2 * 3 + 1 and whole_frames.sum() <= 2 * 4 + 1


def test_raw_features_are_the_model_s_input(spark, recordings):
    signals, classes = recordings
    raw = evaluation.training_features(signals, classes, Feature("raw", 8_000), 200, most=1, masks=(9, 9, 1)).collect()
    wanted = {(r["file"], r["chunk_idx"]): r["samples"] for r in evaluation.training_samples(signals, classes, 200, most=1).collect()}
    assert {(r["file"], r["chunk_idx"]): r["feature"][0] for r in raw} == wanted


def test_models_are_fed_features(spark, recordings):
    signals, _ = recordings
    f = CASES[1]
    scoring.MODELS["mean of two rows"] = lambda: lambda x: np.stack([x[:, :16].mean(1), x[:, 16:32].mean(1)], 1)
    found = evaluation.file_scores(signals, "mean of two rows", 400, 2, method="max", feature=f).collect()
    rows = {r["file"]: np.array(r["samples"]) for r in signals.collect() if r["samples"]}
    assert {r["file"] for r in found} == set(rows)
    for r in found:
        parts = [plain(rows[r["file"]][a : a + 400], f)[r["class"]].mean() for a in range(0, 1600, 400)]
        assert math.isclose(r["s"], max(parts), abs_tol=1e-5)


def test_decibels_below_the_loudest(spark):
    from corvane.functions import arrays

    x = [0.5, -1.0, 1e-9, 0.0, 0.1]
    found = spark.createDataFrame([(x,)], "x array<double>").select(arrays.decibels_below_top(F.col("x"))).first()[0]
    assert np.allclose(found, [20 * math.log10(0.5), 0, -80, -80, -20])
