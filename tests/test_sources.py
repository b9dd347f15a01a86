"""WAV and text sources, and streams."""

import numpy as np
import pytest

from corvane.sources import texts, wav


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(4800) / 10)
    for name, data in (("a", wav.encoded(x, 24_000)), ("b", b"RIFF nothing"), ("c", wav.encoded(np.zeros(100), 24_000))):
        (tmp_path / f"{name}.wav").write_bytes(data)
    found = {r["path"].rsplit("/", 1)[1]: r for r in wav.load(spark, str(tmp_path)).collect()}
    assert len(found["a.wav"]["samples"]) == 4800 and np.allclose(found["a.wav"]["samples"], x / np.abs(x).max(), atol=1e-3)
    assert found["b.wav"]["error"] and not found["b.wav"]["samples"] and set(found["c.wav"]["samples"]) == {0.0}
    spark.dataSource.register(wav.WavSource)
    rows = spark.read.format("wav").load(str(tmp_path)).collect()
    assert sorted(len(r["samples"]) for r in rows) == [0, 100, 4800]
    half = wav.at_rate(wav.load(spark, str(tmp_path)).where("path like '%a.wav'"), 24_000, 12_000).first()
    assert len(half["samples"]) == 2400 and half["sample_rate"] == 12_000
    back = wav.as_files(wav.load(spark, str(tmp_path)).where("error is null")).collect()
    assert all(wav.header(bytes(r["content"]))[1] == 24_000 for r in back)


def test_wav_channels():
    import struct

    data = np.array([[1000, 3000], [2000, -2000]], "<i2").tobytes()
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16)
    body = b"WAVE" + extra + form + b"data" + struct.pack("<I", len(data)) + data
    content = b"RIFF" + struct.pack("<I", len(body)) + body
    assert np.allclose(wav.decoded(content)[1] * 32768, [2000, 0]) and np.allclose(wav.decoded(content, first_channel=True)[1] * 32768, [1000, 2000])


def test_lists(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("b\n a \n\nb\n")
    assert [r["species"] for r in texts.load_species(spark, str(path)).orderBy("line_no").collect()] == ["b", "a", "b"]
    assert [r["species"] for r in texts.open_species(spark, str(path)).collect()] == ["a", "b"]
    path.write_text("\n\n")
    with pytest.raises(ValueError):
        texts.open_species(spark, str(path))
    texts.save_lines(spark.createDataFrame([("x",)], "species string"), "species", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "x"
    assert texts.random_calibration(spark, 5, 3, True).count() == 5
    noise = texts.noise_rows(spark.range(9), "id", 3).collect()
    assert len({v for r in noise for v in r["values"]}) == 27 and noise == texts.noise_rows(spark.range(9), "id", 3).collect()
