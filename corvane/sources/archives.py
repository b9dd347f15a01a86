"""Sinks that write a file a row or an archive a task, and show them when the whole write has succeeded.

    spark.dataSource.register(archives.WavFiles)
    rows.write.format("wavfiles").mode("append").save(folder)      # rows: path, sample_rate, samples
    spark.dataSource.register(archives.NpzArchives)
    rows.write.format("npz").mode("append").save(folder)           # any numbers, strings, and arrays of numbers

Tasks write below `_staging-<id>/<attempt>`; what failed attempts leave there is in no commit message. The
commit moves the files of those that succeeded to their places and removes the staging folder; an abort
removes it with all that is in it. A path twice in one write is an error, before anything is moved.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corvane.sources.wav import encoded


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the files in it."""

    attempt: str
    files: list[str]


def store_of(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Staged(DataSourceArrowWriter):
    """Files of tasks, moved to their places by the commit. Subclasses give (name, bytes) of a task's batches."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.staging = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.folder)
        attempt, names, folders = uuid.uuid4().hex, [], set()
        for name, content in self.files(iterator):
            if posixpath.isabs(name) or ".." in name.split("/") or not name:
                raise ValueError(f"not a path below the folder: {name}")
            target = f"{base}/{self.staging}/{attempt}/{name}"
            if (parent := posixpath.dirname(target)) not in folders:
                store.create_dir(parent, recursive=True)
                folders.add(parent)
            with store.open_output_stream(target) as out:
                out.write(content)
            names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.folder)
        done = [m for m in messages if m is not None]
        names = [name for m in done for name in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a path is written twice")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if posixpath.basename(f.path) != self.staging:
                    store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        folders = set()
        for m in done:
            for name in m.files:
                target = f"{base}/{name}"
                if (parent := posixpath.dirname(target)) not in folders:
                    store.create_dir(parent, recursive=True)
                    folders.add(parent)
                store.move(f"{base}/{self.staging}/{m.attempt}/{name}", target)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = store_of(self.folder)
        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


class WavWriter(Staged):
    def files(self, batches):
        for batch in batches:
            rate, lists = batch.column("sample_rate").to_pylist(), batch.column("samples")
            for i, path in enumerate(batch.column("path").to_pylist()):
                x = lists[i].values
                yield path, encoded(np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False).astype(np.float64), rate[i])


class NpzWriter(Staged):
    """One archive a task: an array a column, lists of one length as matrices, others as arrays of their own."""

    def files(self, batches):
        held = list(batches)  # a task's rows: deal rows to as many tasks as there are to be archives
        table = pa.Table.from_batches(held) if held else None
        if table is None or not len(table):
            return
        arrays = {}
        for name in table.column_names:
            column = table[name].combine_chunks()
            if pa.types.is_list(column.type):
                rows = [np.asarray(x) for x in column.to_pylist()]
                arrays[name] = np.stack(rows) if len({len(x) for x in rows}) == 1 else _ragged(rows)
            else:
                arrays[name] = np.array(column.to_pylist())
        out = io.BytesIO()
        np.savez(out, **arrays)
        yield f"part-{uuid.uuid4().hex}.npz", out.getvalue()


def _ragged(rows: list[np.ndarray]) -> np.ndarray:
    """Rows padded with NaN to the longest."""
    out = np.full((len(rows), max(map(len, rows))), np.nan)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def load_npz(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the archives below a folder, by the columns of `schema`; an archive is a task's rows."""
    kinds = spark.createDataFrame([], schema).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held = np.load(io.BytesIO(content))
                yield pa.RecordBatch.from_arrays([pa.array(held[f.name].tolist()) for f in kinds], [f.name for f in kinds])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(folder).select("content").mapInArrow(rows, kinds)


class WavFiles(DataSource):
    """A WAV file a row."""

    @classmethod
    def name(cls) -> str:
        return "wavfiles"

    def writer(self, schema, overwrite):
        missing = {"path", "sample_rate", "samples"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)[0]}")
        return WavWriter(self.options["path"], overwrite)


class NpzArchives(DataSource):
    """An NPZ archive a task."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def writer(self, schema, overwrite):
        return NpzWriter(self.options["path"], overwrite)
