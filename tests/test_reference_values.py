"""Operators against their steps in plain Python: crops, climbing, mixing, resampling, epochs, capture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import arrays, spectral
from corvane.operators import augment, epochs, evaluation, salience, telemetry, training
from corvane.streaming import device


def plain_crops(x, size, most, q=75.0):
    n = len(x)
    if n <= size:
        return [0]
    frame = max(1, min(1024, size // 4))
    hop = max(1, frame // 2)
    energy = [float(np.mean(np.square(x[i * hop : i * hop + frame]))) for i in range(max(1, 1 + (n - frame) // hop))]
    if max(energy) < 1e-10:
        return [max(0, n // 2 - size // 2)]
    loud = np.array(energy) >= np.percentile(energy, q)
    found, i = [], 0
    while i < len(loud):
        if not loud[i]:
            i += 1
            continue
        j = i
        while j < len(loud) and loud[j]:
            j += 1
        peak = i + int(np.argmax(energy[i:j]))
        found.append((energy[peak], max(0, min(peak * hop - size // 2, n - size))))
        i = j
    taken = []
    for _, start in sorted(found, key=lambda f: -f[0]):
        if len(taken) < most and all(abs(start - t) >= size // 2 for t in taken):
            taken.append(start)
    return taken


@pytest.mark.parametrize("size", [16, 17, 40, 41])
def test_crops(spark, size):
    draw = np.random.default_rng(size)
    signals = [np.zeros(200), np.ones(200), np.zeros(size), np.ones(3)] + [draw.normal(0, draw.random(int(n)) ** 4 + 1e-3) for n in draw.integers(size, 400, 60)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)], "id long, x array<double>")
    found = {r[0]: r[1] for r in df.select("id", salience.crops(F.col("x"), size, 3)).collect()}
    assert all(found[i] == plain_crops(x, size, 3) for i, x in enumerate(signals))
    assert size != 40 or found[0] == [80]


def plain_climb(series, least=128, most=4096, target=8.0):
    n, way, by, last = least, 1, max(32, min(512, least // 2)), None
    for speed, free in series:
        if 0 < free < target:
            n, way, by = max(least, int(n * 0.8)), -1, max(16, by // 2)
        elif last is None:
            n, way = min(most, n + by), 1
        elif speed >= last * 1.01:
            n = min(most, n + by) if way >= 0 else max(least, n - by)
        else:
            by = max(16, by // 2)
            n, way = (max(least, n - by), -1) if way >= 0 else (min(most, n + by), 1)
        last = speed
    return n


def test_backpressure(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [(float(draw.random() * 100), float(draw.choice([0, 4, 16, 32], p=[0.2, 0.1, 0.3, 0.4]))) for _ in range(40)]) for i in range(50)] + [(50, [])]
    df = spark.createDataFrame(rows, "id int, s array<struct<throughput:double,memory_free:double>>")
    assert {r[0]: r[1] for r in df.select("id", device.backpressure(F.col("s"))).collect()} == {i: plain_climb(s) for i, s in rows}


def test_rates_and_limits(spark):
    draw = np.random.default_rng(5)
    rows, wanted = [], {}
    for run in range(10):
        n = int(draw.integers(1, 40))
        rates, losses = 1e-5 * 1.25 ** np.arange(n), draw.random(n)
        rows += [(run, i, float(a), float(b)) for i, (a, b) in enumerate(zip(rates, losses))]
        if n < 7:
            wanted[run] = rates[n // 2]
        else:
            smooth = np.convolve(losses, np.ones(5) / 5, "valid")
            wanted[run] = rates[int(np.argmin(np.gradient(smooth, np.log10(rates[: len(smooth)]))))]
    found = {r[0]: r[1] for r in training.suggested_rate(spark.createDataFrame(rows, "run int, step int, lr double, loss double")).collect()}
    assert all(math.isclose(found[r], wanted[r]) for r in wanted)
    row = spark.range(1).select(arrays.reservoir_limits(F.lit(700), 10, 32, 4).alias("a"), arrays.reservoir_limits(F.lit(10_000_000), 10, 32, 4).alias("b"), arrays.reservoir_limits(F.lit(1), 0, 4, 0).alias("c")).first()
    assert [tuple(x) for x in row] == [(1024, 341), (128, 64), (1024, 341)]


def test_mixing_within_batches(spark):
    """Ids in steps of a thousand: every partner exists, gains add up to 1, and the sums are the plain ones."""
    draw = np.random.default_rng(6)
    rows = [(i * 1000, draw.normal(0, 1, 4).tolist(), [float(j == i % 5) for j in range(5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, samples array<double>, y array<double>")
    pairs = augment.mix_partners(df, 0.25, 0.2).collect()
    gains = {}
    for r in pairs:
        gains.setdefault(r["id"], {})[r["partner"]] = r["gain"]
    data = {i: (np.array(x), np.array(y)) for i, x, y in rows}
    assert 120 <= len(gains) <= 150 and all(abs(sum(g.values()) - 1) < 1e-9 and set(g) <= set(data) for g in gains.values())
    assert {len(g) for g in gains.values()} >= {2, 3} and max(max(g.values()) for g in gains.values()) > 0.95
    for r in augment.mixed(df, augment.mix_partners(df, 0.25, 0.2), smoothing=0.1).collect():
        of = gains.get(r["id"], {r["id"]: 1.0})
        assert np.allclose(r["samples"], sum(g * data[p][0] for p, g in of.items()))
        assert np.allclose(r["y"], 0.9 * np.max([data[p][1] for p in of], axis=0) + 0.02)
    assert augment.mix_partners(df, 0.25, 0.0).count() == 0 and augment.mix_partners(df.limit(1), 1.0).agg(F.sum("gain")).first()[0] == 1


def test_gains_are_dirichlet(spark):
    got = np.array([r[0] for r in spark.range(4000).select(augment.dirichlet(F.col("id"), F.lit(3), 0.5)).collect()])
    assert np.allclose(got.sum(1), 1) and np.allclose(got.mean(0), 1 / 3, atol=0.03)
    assert np.allclose(got.var(0), (1 / 3) * (2 / 3) / (3 * 0.5 + 1), atol=0.01)


def polyphase_by_definition(x, up, down, taps):
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[len(taps) // 2 :]
    return full[: len(wide)][::down][: -(-len(x) * up // down)]


@pytest.mark.parametrize("rates", [(4, 3), (3, 4), (44_100, 24_000), (8_000, 24_000), (2, 1)])
def test_resampling_is_the_filter_s_definition(spark, rates):
    draw = np.random.default_rng(7)
    signals = [draw.normal(0, 1, n) for n in (1, 5, 64, 64, 333)]
    up, down, taps = spectral.polyphase(*rates)
    assert abs(taps.sum() - up) < 1e-9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)] + [(90, []), (91, None)], "id int, x array<double>")
    found = {r[0]: r[1] for r in df.select("id", spectral.resampled(*rates)("x")).collect()}
    assert found[90] == [] and found[91] is None
    assert all(np.allclose(found[i], polyphase_by_definition(x, up, down, taps), atol=1e-9) for i, x in enumerate(signals))


def test_spectra_of_different_lengths(spark):
    draw = np.random.default_rng(8)
    signals = [draw.normal(0, 1, n) for n in (3, 16, 64, 64, 100)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)] + [(9, None)], "id int, x array<double>")
    window = spectral.hann(16, False)
    got = {r[0]: (r[1], r[2]) for r in df.withColumn("s", spectral.stft(16, 8, centred=True)("x")).select("id", "s", spectral.pcen()("s")).collect()}
    b = spectral.smoothing(0.4, 22_050, 512)
    for i, x in enumerate(signals):
        wide = np.pad(x, 8)
        wide = np.pad(wide, (0, max(0, 16 - len(wide))))
        wanted = np.array([np.abs(np.fft.rfft(wide[a : a + 16] * window)) for a in range(0, len(wide) - 15, 8)])
        assert np.allclose(got[i][0], wanted)
        m, out = 1.0, []  # the library's default state: what a steady unit input leaves
        for frame in wanted * 2**31:
            m = (1 - b) * m + b * frame
            out.append(2**0.5 * ((frame / (1e-6 + m) ** 0.98 / 2 + 1) ** 0.5 - 1))
        assert np.allclose(got[i][1], out, rtol=1e-6)
    assert got[9] == (None, None)


def test_epochs_go_through_the_buffer(spark):
    rows = spark.range(300).withColumn("x", F.array(F.col("id").cast("double")))
    turns = epochs.epochs(rows, 20, 8, shards=3)
    first, second = next(turns).collect(), next(turns).collect()
    assert sorted(r["id"] for r in first) == list(range(300)) and [r["id"] for r in first] != [r["id"] for r in second]
    order = {r["id"]: (r[1], r[2]) for r in rows.select("id", augment.uniform(F.col("id"), "shard", "0"), augment.uniform(F.col("id"), "order", "0")).collect()}
    for shard in range(3):
        own = sorted((i for i in order if int(order[i][0] * 3) == shard), key=lambda i: (order[i][1], i))
        wanted = list(epochs.drained(20, 8, np.random.default_rng([42, 0, shard]), iter([(i,) for i in own])))
        # The buffer holds rows; shuffles move places, whatever is in them.
        assert [r["id"] for r in sorted((r for r in first if r["shard"] == shard), key=lambda r: r["place"])] == [i for (i,) in wanted]
        assert all(own.index(i) < at + 20 for at, (i,) in enumerate(wanted))
    assert epochs.epoch(rows.limit(0), 0, 20, 8).count() == 0


def test_capture_ends_by_marker_or_deadline(spark):
    lines = [("a", i, i * 1.0, "=== DONE === x" if i == 3 else "y") for i in range(20)] + [("b", i, i * 1.0, "y") for i in range(20)] + [("c", i, i * 1.0, "=== DONE ===" if i == 9 else "y") for i in range(12)]
    found = telemetry.captured(spark.createDataFrame(lines, device.TIMED_LINES), 10.0).groupBy("device").agg(F.max("line_no")).collect()
    assert {r[0]: r[1] for r in found} == {"a": 8, "b": 9, "c": 11}


def test_long_logs_are_cut_into_ranges(spark, monkeypatch):
    lines = [("d", i, f"[{i // 7}/9] f{i}.wav" if i % 7 == 2 else "  other") for i in range(100)] + [("e", 5, "  none")]
    df = spark.createDataFrame(lines, "device string, line_no long, line string")
    whole = sorted(map(str, telemetry.with_files(df).collect()))
    monkeypatch.setattr(telemetry, "RANGE_LINES", 3)
    assert sorted(map(str, telemetry.with_files(df).collect())) == whole and "f93.wav" in whole[-2]


def test_silent_files_become_noise(spark):
    df = spark.createDataFrame([(1, "a", []), (2, "a", None), (3, "zz", [])], "file long, label string, samples array<double>")
    found = evaluation.training_samples(df, spark.createDataFrame([(0, "a")], "class_idx int, class string"), 10).collect()
    assert {r["file"] for r in found} == {1, 2} and all(r["class_idx"] is None and len(set(r["samples"])) == 10 for r in found)


def test_focal_loss_of_logits(spark):
    for y, x in ((1.0, 2.0), (0.0, 2.0), (1.0, -800.0), (0.0, 800.0)):
        got = spark.range(1).select(arrays.binary_focal_loss(F.lit(y), F.lit(x), 0.0, from_logits=True)).first()[0]
        assert math.isclose(got, max(x, 0) - x * y + math.log1p(math.exp(-abs(x))))


def test_settings_fall_back_to_the_other_format(tmp_path):
    (tmp_path / "c.toml").write_text("[deploy]\nbaud = 5\n")
    assert config.resolve(path=str(tmp_path / "c.json"), environment={}).baud == 5
    assert config.resolve(path=str(tmp_path / "none.json"), environment={}).baud == 115_200
    with pytest.raises(ValueError, match="dropout_rate"):
        config.ModelConfig(dropout_rate=1.0)
