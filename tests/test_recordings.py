"""FLAC against an encoder of the tests; windows of recordings against whole files; sinks that commit."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import flac_files  # noqa: E402

from corvane.functions import spectral  # noqa: E402
from corvane.sources import archives, flac, recordings, wav  # noqa: E402


def tone(n, channels=1, bits=16, seed=0):
    draw = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    x = 0.4 * np.sin(t / (7 + np.arange(channels))) + 0.05 * draw.normal(0, 1, (n, channels))
    return np.clip(np.round(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)


KINDS = ["constant", "verbatim", *(f"fixed-{i}" for i in range(5)), *(f"linear-{i}" for i in range(1, 5))]


@pytest.mark.parametrize("kind", KINDS)
def test_every_kind_of_subframe(kind):
    for n in (1, 3, 192, 500):
        x = tone(n)
        rate, found = flac.decoded(flac_files.encode(x, kinds=(kind,)))
        assert rate == 24_000 and (found * 32768 == x).all()
    same = np.full((300, 1), -77)
    assert (flac.decoded(flac_files.encode(same, kinds=(kind,)))[1] * 32768 == same).all()


@pytest.mark.parametrize("layout", ["independent", "left", "right", "mid"])
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_layouts_and_widths(layout, bits):
    x = tone(700, 2, bits)
    content = flac_files.encode(x, bits=bits, layout=layout, kinds=KINDS, parts_log=2, variable=True)
    assert (flac.decoded(content)[1] * (1 << (bits - 1)) == x).all()


def test_wasted_bits_escapes_and_more_channels():
    x = tone(400, 3) << 2
    x = np.clip(x, -32768, 32764)
    assert (flac.decoded(flac_files.encode(x, kinds=("fixed-1", "linear-2", "verbatim"), wasted=2))[1] * 32768 == x).all()
    y = tone(384, 1)
    assert (flac.decoded(flac_files.encode(y, kinds=("fixed-3",), parts_log=3, escape=True))[1] * 32768 == y).all()


def test_windows_start_at_known_places():
    x = tone(5_000)
    content = flac_files.encode(x, seek_every=4)
    stream, read = flac.info(content), []

    def ranged(at, n):
        out = content[stream.start + at : stream.start + at + n]
        read.append(len(out))
        return out

    for first, count in ((0, 10), (191, 2), (4_000, 300), (4_990, 50), (5_000, 5)):
        read.clear()
        assert (flac.window(ranged, stream, first, count) * 32768 == x[first : first + count]).all()
        assert sum(read) < 6_000
    assert len(stream.seeks) == 7


def test_broken_streams():
    x = tone(600)
    good = flac_files.encode(x, kinds=("fixed-2",))
    start = flac.info(good).start
    for bad in (b"fLaX" + good[4:], good[:20], good[: start + 40], good[:-30] + bytes([good[-30] ^ 4]) + good[-29:], good[: start + 3] + b"\xff" + good[start + 4 :]):
        with pytest.raises(ValueError):
            flac.decoded(bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of two kinds and three rates, nested, and broken ones."""
    base = tmp_path_factory.mktemp("recordings")
    (base / "a").mkdir()
    for i, (rate, n) in enumerate(((8_000, 16_000), (24_000, 120_000), (16_000, 4_000))):
        x = tone(n, seed=i)
        (base / "a" / f"w{i}.wav").write_bytes(wav.encoded(x[:, 0] / 32768, rate))
        (base / f"f{i}.FLAC").write_bytes(flac_files.encode(x, rate=rate, block=4_096, kinds=("fixed-2",), seek_every=2))
    (base / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt ")
    (base / "bad.flac").write_bytes(b"fLaC")
    (base / "empty.wav").write_bytes(b"")
    (base / "text.txt").write_bytes(b"no recording")
    return base


def read(spark, folder, **options):
    return recordings.load(spark, str(folder), **options)


def whole(path):
    content = Path(path).read_bytes()
    if path.lower().endswith(".wav"):
        return wav.decoded(content)
    rate, x = flac.decoded(content)
    return rate, x.mean(1)


def test_whole_files(spark, folder):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in read(spark, folder, normalize="false").collect()}
    assert set(rows) == {"w0.wav", "w1.wav", "w2.wav", "f0.FLAC", "f1.FLAC", "f2.FLAC", "bad.wav", "bad.flac", "empty.wav"}
    for name, r in rows.items():
        if name.startswith(("bad", "empty")):
            assert r["error"] and r["samples"] == [] and r["sample_rate"] is None
            continue
        rate, x = whole(r["path"])
        assert r["sample_rate"] == rate and np.allclose(r["samples"], x) and r["start"] == 0.0 and r["error"] is None


@pytest.mark.parametrize("offset", ["start", "random", "all"])
def test_windows_are_those_of_the_whole(spark, folder, offset):
    rows = read(spark, folder, seconds="0.5", offset=offset, chunk="0.75").where("error IS NULL").collect()
    assert len(rows) == (6 if offset != "all" else 2 * (4 + 10 + 1))
    for r in rows:
        rate, x = whole(r["path"])
        first = int(r["start"] * rate)
        own = x[first : first + min(len(x), rate // 2)]
        assert len(r["samples"]) == len(own) and np.allclose(r["samples"], own / np.abs(own).max())
        if offset == "random":
            assert r["start"] == recordings.drawn(r["path"].rsplit("/", 1)[-1], 42) * max(0.0, len(x) / rate - max(0.75, min(0.5, len(x) / rate)))
        if "w1" in r["path"]:
            assert r["bytes_read"] < 0.12 * 240_000
        if "f1" in r["path"]:
            assert r["bytes_read"] < 0.5 * Path(r["path"]).stat().st_size
    assert len({r["start"] for r in rows}) > (3 if offset == "random" else 0)


def test_mixed_rates_become_one(spark, folder):
    for r in read(spark, folder, rate="12000", normalize="false").where("error IS NULL").collect():
        rate, x = whole(r["path"])
        wanted = spectral.resample(x[None, :], *spectral.polyphase(rate, 12_000))[0]
        assert r["sample_rate"] == 12_000 and np.allclose(r["samples"], wanted)


def test_conditions_are_taken_over(spark, folder):
    from corvane.session import settings

    with settings(spark, spark__sql__python__filterPushdown__enabled="false"):
        assert read(spark, folder).where(F.col("path") == f"{folder}/a/w1.wav").count() == 1
    with settings(spark, spark__sql__python__filterPushdown__enabled="true"):
        df = read(spark, folder, seconds="0.5", offset="all")
        path = f"{folder}/a/w1.wav"
        own = df.where((F.col("path") == path) & (F.col("start") >= 2.0) & (F.col("start") < 3.0))
        rows = own.collect()
        assert sorted(r["start"] for r in rows) == [2.0, 2.5] and {r["path"] for r in rows} == {path}
        assert sum(r["bytes_read"] for r in rows) < 60_000
        some = {r["path"] for r in df.where(F.col("path").startswith(f"{folder}/a/")).select("path").collect()}
        assert some == {f"{folder}/a/w{i}.wav" for i in range(3)}
    reader = recordings.Pushed({"path": str(folder)})
    left = list(reader.pushFilters([recordings.EqualTo(("path",), path), recordings.GreaterThan(("start",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    assert [[p for p, _ in part.files] for part in reader.partitions()] == [[path]]


def test_files_are_dealt_by_bytes(folder, monkeypatch):
    monkeypatch.setattr(recordings, "TASK_BYTES", 1)
    parts = recordings.Reader({"path": str(folder)}).partitions()
    assert len(parts) == 9 and all(len(p.files) == 1 for p in parts)


# Sinks.


def files_in(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_a_wav_file_a_row(spark, tmp_path):
    rows = [(f"set/{i % 3}/x{i}.wav", 8_000, tone(50 + i, seed=i)[:, 0].astype(float) / 32768) for i in range(20)]
    spark.dataSource.register(archives.WavFiles)
    df = spark.createDataFrame([(p, r, x.tolist()) for p, r, x in rows], "path string, sample_rate int, samples array<double>").repartition(4)
    df.write.format("wavfiles").mode("append").save(str(tmp_path))
    assert files_in(tmp_path) == sorted(p for p, _, _ in rows)
    back = {r["path"][len(str(tmp_path)) + 1 :]: r for r in read(spark, tmp_path, normalize="false").collect()}
    assert all(np.allclose(back[p]["samples"], x, atol=1e-4) and back[p]["sample_rate"] == r for p, r, x in rows)


def test_failing_writes_leave_nothing(spark, tmp_path):
    spark.dataSource.register(archives.WavFiles)
    (tmp_path / "kept.txt").write_text("here before")
    schema = "path string, sample_rate int, samples array<double>"
    bad = spark.range(8).select(F.format_string("f%d.wav", "id").alias("path"), F.when(F.col("id") == 5, F.raise_error(F.lit("broken")).cast("int")).otherwise(8_000).alias("sample_rate"), F.array(F.lit(0.5)).alias("samples"))
    cases = [bad.repartition(4), spark.createDataFrame([("x.wav", 1, [0.0]), ("x.wav", 1, [0.1])], schema).repartition(2), spark.createDataFrame([("../x.wav", 1, [0.0])], schema)]
    for df in cases:
        with pytest.raises(Exception):  # noqa: B017
            df.write.format("wavfiles").mode("append").save(str(tmp_path))
        assert files_in(tmp_path) == ["kept.txt"]


def test_archives_hold_columns(spark, tmp_path):
    spark.dataSource.register(archives.NpzArchives)
    df = spark.range(30).select("id", F.array(*(F.col("id") * i for i in range(3))).cast("array<double>").alias("x"), F.concat(F.lit("n"), "id").alias("name"))
    df.repartition(3).write.format("npz").mode("append").save(str(tmp_path))
    parts = [np.load(tmp_path / f) for f in files_in(tmp_path)]
    assert 1 <= len(parts) <= 3 and sorted(int(i) for p in parts for i in p["id"]) == list(range(30))
    for p in parts:
        assert (p["x"] == p["id"][:, None] * np.arange(3)).all() and list(p["name"]) == [f"n{i}" for i in p["id"]]
    df.limit(2).coalesce(1).write.format("npz").mode("overwrite").save(str(tmp_path))
    assert len(files_in(tmp_path)) == 1
