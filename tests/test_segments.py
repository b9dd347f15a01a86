"""Recordings in segments give what whole arrays give, wherever they are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays, spectral
from corvane.operators import salience, segments


@pytest.fixture(scope="module")
def signals(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i, n in enumerate((700, 640, 1300, 100, 37, 3, 1)):
        x = draw.normal(0, 0.02, n)
        for _ in range(5):
            a = int(draw.integers(n))
            x[a : a + 40] += np.sin(np.arange(len(x[a : a + 40])) / 2) * draw.random()
        rows.append((i, x.tolist()))
    rows += [(90, [0.0] * 500), (91, np.sin(np.arange(900) / 3).tolist())]
    return spark.createDataFrame(rows, "file long, samples array<double>").cache()


CUTS = [1_000_000, 333, 64, 17]


@pytest.mark.parametrize("length", CUTS)
def test_energies(signals, length):
    whole = signals.select("file", F.posexplode(arrays.short_time_energy(F.col("samples"), 50, 20)).alias("t", "energy")).collect()
    found = segments.energies(segments.cut(signals, length), 50, 20, length).collect()
    assert len(found) == len(whole) > 150
    by = {(r["file"], r["t"]): r["energy"] for r in found}
    assert all(abs(by[r["file"], r["t"]] - r["energy"]) < 1e-12 for r in whole)


@pytest.mark.parametrize("length", CUTS)
def test_activity(signals, length):
    whole = {r[0]: r[1] for r in signals.select("file", salience.activity_ratio(F.col("samples"))).collect()}
    found = {r[0]: r[1] for r in segments.activity(segments.cut(signals, length), length).collect()}
    assert found.keys() == whole.keys() and all(abs(found[f] - whole[f]) < 1e-12 for f in whole) and max(whole.values()) > 0


@pytest.mark.parametrize("length", CUTS)
@pytest.mark.parametrize("size, most", [(120, 3), (60, 8)])
def test_crops(signals, length, size, most):
    whole = {r[0]: r[1] for r in signals.select("file", salience.crops(F.col("samples"), size, most)).collect()}
    found = {r[0]: r[1] for r in segments.crops(segments.cut(signals, length), length, size, most).collect()}
    assert found == whole and max(map(len, whole.values())) > 1


@pytest.mark.parametrize("length", [1_000, 7, 2, 1])
def test_gain_control(signals, length):
    spectra = signals.select("file", spectral.stft(32, 16, centred=True)(F.col("samples")).alias("s"))
    whole = {r[0]: np.array(r[1]) for r in spectra.select("file", spectral.pcen(rate=8_000, hop=16)(F.col("s"))).collect()}
    cut = segments.cut(spectra, length, samples="s").withColumnRenamed("samples", "frames")
    found = {}
    for r in segments.gain_controlled(cut, 8_000, 16).orderBy("file", "segment").collect():
        found.setdefault(r["file"], []).extend(r["frames"])
    assert found.keys() == whole.keys() and all(np.allclose(found[f], whole[f], rtol=1e-9) for f in whole)
