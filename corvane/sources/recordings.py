"""Windows of recordings, WAV and FLAC, as a data source that reads the bytes it needs.

    recordings.load(spark, folder, seconds=3, offset="random")

A row is a window of a file: path, start (seconds), sample_rate, samples, bytes_read, error. Options:
`seconds` (none or 0: to the end), `offset` (`start`: one window from the beginning; `random`: one from a place
that a digest of the file's name and `seed` draws; `all`: one after the other), `chunk` (seconds that a drawn
window leaves room for at least), `rate` (resample all files to it), `normalize` (by the window's peak).

Files are listed once and dealt to tasks by bytes. A task reads a file's header and its window by ranges;
conditions on `path` and `start` are taken over from the query (where spark.sql.python.filterPushdown.enabled is
set, as corvane.session does), so other files are not opened and other windows not read. Broken files are a row with an error and no
samples; of a file whose later frames are broken, earlier windows are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from corvane.functions.spectral import polyphase, resample
from corvane.sources import flac, wav

SCHEMA = "path string, start double, sample_rate int, samples array<double>, bytes_read long, error string"
KINDS = (".wav", ".flac")
#: Bytes of files of a task, about, and those of a header that are read at first.
TASK_BYTES, HEAD_BYTES = 64_000_000, 4_096
#: Rows of a batch, and numbers.
BATCH_ROWS, BATCH_NUMBERS = 256, 2_000_000


class Ranged:
    """A file read by ranges; `taken` counts the bytes."""

    def __init__(self, file, size: int):
        self.file, self.size, self.taken = file, size, 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(min(at, self.size))
        out = self.file.read(max(0, min(n, self.size - at)))
        self.taken += len(out)
        return out


@dataclass(frozen=True)
class Opened:
    """A recording's rate and frames, and a function (first, count) to its mean samples."""

    rate: int
    frames: int
    samples: object


def opened(source: Ranged, kind: str) -> Opened:
    if kind == ".flac":
        head = source.read(0, HEAD_BYTES)
        while True:
            try:
                stream = flac.info(head)
                break
            except flac.Broken as e:
                needed = str(e).split(" ")
                if needed[:2] != ["header", "needs"] or int(needed[2]) > source.size:
                    raise
                head += source.read(len(head), int(needed[2]) + HEAD_BYTES - len(head))
        read = lambda at, n: source.read(stream.start + at, n)
        return Opened(stream.rate, stream.frames, lambda first, count: flac.window(read, stream, first, count).mean(1))
    channels, rate, bits, at, _, frames = wav_header(source)
    width = channels * bits // 8
    return Opened(rate, frames, lambda first, count: wav.values(source.read(at + first * width, count * width), bits).reshape(-1, channels).mean(1))


def wav_header(source: Ranged) -> tuple[int, int, int, int, int, int]:
    """As wav.header, from the chunks' heads alone."""
    head = source.read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, b""
    while len(chunk := source.read(at, 24)) >= 8:
        kind, size = chunk[:4], struct.unpack_from("<I", chunk, 4)[0]
        if kind == b"fmt ":
            form = chunk
        elif kind == b"data":
            fake = head + form + b"data" + struct.pack("<I", 0)  # the same checks as of a whole file
            channels, rate, bits, *_ = wav.header(fake)
            size, frame = min(size, source.size - at - 8), channels * bits // 8
            return channels, rate, bits, at + 8, size, size // frame if frame else 0
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(16)
def taps_of(rate_in: int, rate_out: int):
    return polyphase(rate_in, rate_out)


def drawn(name: str, seed: int) -> float:
    """A number between 0 and 1 from a file's name."""
    return (int(hashlib.md5(f"{seed}:window:{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32


def windows(frames: int, rate: int, seconds: float, offset: str, chunk: float, name: str, seed: int) -> Iterator[tuple[float, int, int]]:
    """(start in seconds, first frame, frames) of the windows of a recording."""
    whole = frames / rate
    length = min(seconds, whole) if seconds > 0 else whole
    if offset == "all":
        step = max(1, int(length * rate))
        for first in range(0, frames, step):
            yield first / rate, first, min(step, frames - first)
        return
    start = drawn(name, seed) * max(0.0, whole - max(chunk, length)) if offset == "random" else 0.0
    first = min(int(start * rate), frames)
    yield start, first, int(min(frames - first, length * rate))


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, options):
        get = lambda name, default: options.get(name, default)
        self.folder = options["path"]
        self.seconds, self.chunk, self.seed = float(get("seconds", 0)), float(get("chunk", 0)), int(get("seed", 42))
        self.offset, self.rate, self.normalize = get("offset", "start"), int(get("rate", 0)), str(get("normalize", "true")).lower() == "true"
        if self.offset not in ("start", "random", "all"):
            raise ValueError(f"unknown offset: {self.offset}")
        self.paths: list[tuple[str, object]] = []
        self.starts: list[tuple[str, float]] = []

    def wanted(self, path: str) -> bool:
        fits = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith}
        return all(fits[kind](value) for kind, value in self.paths)

    def in_time(self, start: float) -> bool:
        fits = {"EqualTo": start.__eq__, "GreaterThan": start.__gt__, "GreaterThanOrEqual": start.__ge__, "LessThan": start.__lt__, "LessThanOrEqual": start.__le__}
        return all(fits[kind](float(value)) for kind, value in self.starts)

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self):
        from pyarrow import fs

        store, base = self.store()
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.lower().endswith(KINDS) and not any(p.startswith(("_", ".")) for p in f.path[len(base) :].split("/")))
        out, held = [], 0
        for path, size in found:
            if not self.wanted(path):
                continue
            if not out or held + size > TASK_BYTES:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += size
        return [Part(files) for files in out] or [Part([])]

    def rows(self, store, path: str, size: int) -> Iterator[tuple]:
        try:
            with store.open_input_file(path) as file:
                source = Ranged(file, size)
                recording = opened(source, path[path.rfind(".") :].lower())
                if recording.frames <= 0 or recording.rate <= 0:
                    raise ValueError("no samples")
                for start, first, count in windows(recording.frames, recording.rate, self.seconds, self.offset, self.chunk, path.rsplit("/", 1)[-1], self.seed):
                    if not self.in_time(start):
                        continue
                    x = recording.samples(first, count)
                    if self.rate and self.rate != recording.rate:
                        x = resample(x[None, :], *taps_of(recording.rate, self.rate))[0]
                    peak = np.abs(x).max(initial=0.0)
                    yield path, start, self.rate or recording.rate, x / peak if self.normalize and peak > 0 else x, source.taken, None
                    source.taken = 0
        except Exception as e:  # a bad recording must not end the scan
            yield path, None, None, np.zeros(0), 0, str(e)[:200] or type(e).__name__

    def read(self, partition):
        store, _ = self.store()
        held: list[tuple] = []
        numbers = 0
        for path, size in partition.files:
            for row in self.rows(store, path, size):
                held.append(row)
                numbers += len(row[3])
                if len(held) >= BATCH_ROWS or numbers >= BATCH_NUMBERS:
                    yield batch(held)
                    held, numbers = [], 0
        if held:
            yield batch(held)


class Pushed(Reader):
    """A reader that takes conditions over; Spark refuses one where its setting for that is off."""

    def pushFilters(self, filters: list[Filter]):
        """Takes over what can be told from a path, or from a window's start; all else is left to the query."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, EqualTo | In | StringStartsWith):
                self.paths.append((type(f).__name__, value))
            elif column == ("start",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.starts.append((type(f).__name__, value))
                yield f  # broken files have no start, so the query looks again
            else:
                yield f


def batch(rows: list[tuple]) -> pa.RecordBatch:
    path, start, rate, samples, taken, error = zip(*rows, strict=True)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in samples]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(samples).astype(np.float64)))
    columns = [pa.array(path, pa.string()), pa.array(start, pa.float64()), pa.array(rate, pa.int32()), lists, pa.array(taken, pa.int64()), pa.array(error, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "start", "sample_rate", "samples", "bytes_read", "error"])


class Recordings(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (Pushed if str(self.options.get("pushdown", "false")).lower() == "true" else Reader)(self.options)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Windows of all recordings below a folder."""
    spark.dataSource.register(Recordings)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("recordings").options(**{k: str(v) for k, v in options.items()}, pushdown=pushdown).load(folder)
