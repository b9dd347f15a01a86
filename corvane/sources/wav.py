"""PCM WAV files as rows of samples: a decoder over binaryFile, a Python data source, and a sink.

Only WAV is decoded; other recordings, and files that cannot be read, give a row with an error.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.spectral import resampled

HEADER = "channels int, sample_rate int, bits int, data_offset long, data_bytes long, frames long"
SIGNALS = "path string, sample_rate int, samples array<double>, error string"


def header(content: bytes) -> tuple[int, int, int, int, int, int]:
    """Channels, rate, bits, place and bytes of the samples, frames; chunks of other kinds are passed over (odd ones are padded)."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, at + 8)
            if form[0] != 1:
                raise ValueError("not PCM")
        elif kind == b"data":
            if form is None:
                raise ValueError("samples before their format")
            size = min(size, len(content) - at - 8)
            frame = form[1] * form[5] // 8
            return form[1], form[2], form[5], at + 8, size, size // frame if frame else 0
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def values(raw: bytes, bits: int) -> np.ndarray:
    """Samples from -1 to 1 of little-endian integers."""
    if bits == 16:
        return np.frombuffer(raw, "<i2") / 32768.0
    if bits == 8:
        return (np.frombuffer(raw, np.uint8) - 128.0) / 128.0
    if bits == 32:
        return np.frombuffer(raw, "<i4") / 2147483648.0
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    raise ValueError(f"{bits} bits")


def decoded(content: bytes, first_channel: bool = False, start: float = 0.0, seconds: float | None = None) -> tuple[int, np.ndarray]:
    """Rate and samples from -1 to 1 of a window: the channels' mean, or the first channel as devices read it."""
    channels, rate, bits, at, _, frames = header(content)
    first = min(frames, int(start * rate))
    count = frames - first if seconds is None else min(frames - first, int(seconds * rate))
    width = channels * bits // 8
    raw = content[at + first * width : at + (first + count) * width]
    table = values(raw, bits).reshape(-1, channels)
    return rate, table[:, 0] if first_channel else table.mean(1)


def signals(files: DataFrame, first_channel: bool = False, start: float = 0.0, seconds: float | None = None, normalize: bool = True) -> DataFrame:
    """Rows (path, sample_rate, samples, error) from rows (path, content); errors leave the samples empty."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rate, x = decoded(bytes(content), first_channel, start, seconds)
                    peak = np.abs(x).max(initial=0)
                    rows.append((path, rate, x / peak if normalize and peak > 0 else x, None))
                except Exception as e:  # a bad recording must not end the scan
                    rows.append((path, None, np.zeros(0), str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples", "error"])

    return files.select("path", "content").mapInPandas(read, SIGNALS)


def load(spark: SparkSession, folder: str, **window) -> DataFrame:
    """Signals of all WAV files under a folder."""
    return signals(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(folder), **window)


def at_rate(rows: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Signals of one rate at another; others stay."""
    changed = resampled(rate_in, rate_out)
    own = F.col("sample_rate") == rate_in
    return rows.withColumns({"samples": F.when(own, changed(F.when(own, F.col("samples")))).otherwise(F.col("samples")), "sample_rate": F.when(own, F.lit(rate_out)).otherwise(F.col("sample_rate"))})


def encoded(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def as_files(rows: DataFrame) -> DataFrame:
    """Rows (path, content): WAV files of signals, for a sink of binary rows or a file per row."""
    @F.pandas_udf("binary")
    def content(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([encoded(np.asarray(x, float), int(r)) for x, r in zip(samples, rate, strict=True)])

    return rows.select("path", content("samples", "sample_rate").alias("content"))


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.files_per_part = options["path"], int(options.get("filesPerPartition", 64))

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.path.lower().endswith(".wav"))
        return [_Part(paths[i : i + self.files_per_part]) for i in range(0, len(paths), self.files_per_part)] or [_Part([])]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        for path in partition.paths:
            with store.open_input_file(path) as f:
                content = f.read()
            try:
                rate, x = decoded(content)
                yield path, rate, [float(v) for v in x], None
            except Exception as e:  # as in signals()
                yield path, None, [], str(e)[:200]


class WavSource(DataSource):
    """spark.dataSource.register(WavSource); spark.read.format("wav").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SIGNALS

    def reader(self, schema):
        return _Reader(self.options)
