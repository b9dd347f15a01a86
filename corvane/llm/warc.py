"""WARC archives and a two-level capture index.

Pages are written as WARC 1.1 records, one gzip member each: of pages with equal payloads of some size,
the one with the smallest id is a response and the others revisit it. The index has a line per record,
keyed by the URL with its host reversed; sorted lines go to compressed blocks of some thousand lines,
and a sparse directory keeps the first key and the place of each block. A lookup finds the block in the
directory by binary search, reads that range, finds the line by binary search, and reads the record's
range. Every attempt of a task writes files of its own, complete before they get their name; lines
and directory name the files of attempts that counted. The folder is in storage all executors share.

Defined results: null html is an empty payload; a null url has the key `)`, an empty host before it; equal ids with equal
payloads are all responses (none can refer to itself); a null id never is the response of others; very long
URLs and payloads are written and read whole; an empty table makes no files and an empty result; columns other than the id, url and html do not matter.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import FREQUENT, joined, shared_dir, written

LEAST_BYTES, BLOCK_LINES = 100, 2_000
#: Payloads with copies (a digest and an id each) that are sent to all tasks; beyond, pages are merged with them by shuffle.
COPIES = 500_000
#: Rows of the directory, about, at most: beyond as many blocks of BLOCK_LINES, blocks have more lines.
DIRECTORY_ROWS = 100_000
#: Index lines per index file, about.
FILE_LINES = 1_000_000
#: Ranges of an archive closer than this are read together.
GAP_BYTES = 64_000
DATE = "2024-01-01T00:00:00Z"

ENTRIES = "urlkey string, page_id long, record_type string, payload_digest string, file string, offset long, length long"
DIRECTORY = "urlkey string, lasturlkey string, file string, offset long, length long, n_lines long"


def url_key(url: Column) -> Column:
    """Host reversed by its labels with commas, then `)` and the rest: `https://a.example.com/x?y` is `com,example,a)/x?y`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:[^:/?#]*://)?(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1))


def planned(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, payload_digest, payload_bytes, refers_to): refers_to is null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    copies = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies, "page-copies")
    n, most = copies.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = copies.select("payload_digest", "first")
    if n <= COPIES:  # few enough for all tasks: no page is moved
        found = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        found = joined(rows, firsts, "payload_digest", written(copies.where(F.col("n") > most * FREQUENT).select("payload_digest"), "frequent-pages"), "left")
    return found.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def _record(page_id, url: str, html: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n", 6, mtime=0)


def _id(mark: str | None) -> int | None:
    digits = (mark or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parsed(data: bytes) -> dict:
    """A record's id, type, payload size, digest and response; the payload of a response is measured, that of a revisit stated."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    kind, stated = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != size):
        raise ValueError(f"payload of record {warc['WARC-Record-ID']} differs from its header")
    return {"page_id": _id(warc["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": _id(warc.get("WARC-Refers-To")), "payload": payload}


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


class Target:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.at = self.fs.open_output_stream(self.draft), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        begin, self.at = self.at, self.at + len(data)
        return begin, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def ranges(folder: str, wanted: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each (file, offset, length), in order of file and offset; close ranges are read at once."""
    fs, base = pafs.FileSystem.from_uri(folder)
    i = 0
    while i < len(wanted):
        name, begin, _ = wanted[i]
        end, j = begin, i
        while j < len(wanted) and wanted[j][0] == name and wanted[j][1] <= end + GAP_BYTES and wanted[j][1] + wanted[j][2] - begin <= 8_000_000 or j == i:
            end = max(end, wanted[j][1] + wanted[j][2])
            j += 1
        with fs.open_input_file(f"{base}/{name}") as f:
            f.seek(begin)
            data = f.read(end - begin)
        for _, at, n in wanted[i:j]:
            yield data[at - begin : at - begin + n]
        i = j


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task; returns the index's lines (ENTRIES), a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = f"pages-{_attempt()}.warc.gz"
            target = target or Target(folder, name)
            keys, ids, urls, htmls, digests, refers = (batch.column(i) for i in range(6))
            places = []
            for i, u, h, d, r in zip(ids.to_pylist(), urls.to_pylist(), htmls.to_pylist(), digests.to_pylist(), refers.to_pylist(), strict=True):
                places.append(target.add(_record(i, u or "", h, d, r)))
            kinds = pa.array(["response" if r is None else "revisit" for r in refers.to_pylist()])
            offsets, lengths = (pa.array(x, pa.int64()) for x in zip(*places, strict=True))
            yield pa.RecordBatch.from_arrays([keys, ids, kinds, digests, pa.array([name] * len(places)), offsets, lengths], [x.split()[0] for x in ENTRIES.split(", ")])
        if target:
            target.close()

    rows = planned(pages).select(url_key(F.col("url")).alias("urlkey"), F.col("page_id").cast("long"), "url", F.col("html").cast("binary"), "payload_digest", F.col("refers_to").cast("long"))
    return written(rows.mapInArrow(write, ENTRIES), "captures")


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted lines in compressed blocks; returns the directory (DIRECTORY), a written table."""
    names = [x.split()[0] for x in DIRECTORY.split(", ")]
    total = entries.count()
    block = max(BLOCK_LINES, -(-total // DIRECTORY_ROWS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, lines, found = None, [], []

        def flush() -> None:
            begin, n = target.add(zlib.compress("\n".join(map(json.dumps, lines)).encode()))
            found.append({"urlkey": lines[0]["urlkey"], "lasturlkey": lines[-1]["urlkey"], "file": name, "offset": begin, "length": n, "n_lines": len(lines)})
            lines.clear()

        for batch in batches:
            if batch.num_rows and target is None:
                name = f"index-{_attempt()}.gz"
                target = Target(folder, name)
            for row in batch.to_pylist():
                lines.append(row)
                if len(lines) == block:
                    flush()
        if target:
            if lines:
                flush()
            target.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.string() if n in ("urlkey", "lasturlkey", "file") else pa.int64()) for n in names], names)

    order = ["urlkey", "file", "offset"]
    files = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_LINES))
    return written(entries.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(blocks, DIRECTORY), "directory")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(entries: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that `entries` points to, by range reads in order of file and offset; with `payload`, their payloads too."""
    schema = READ + ", payload binary" if payload else READ
    fields = [(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in schema.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True))
            rows = [parsed(x) for x in ranges(folder, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in fields], [n for n, _ in fields])

    places = entries.select("file", "offset", "length")
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Index lines of the URL keys in column `urlkey`: binary search in the directory, a range read per block, binary search in the block.

    The directory has DIRECTORY_ROWS rows, about, whatever the index holds. A key whose lines go on over
    many blocks is looked up in each by itself.
    """
    names = ("urlkey", "lasturlkey", "file", "offset", "length")
    blocks = directory.select(*names).orderBy("urlkey", "lasturlkey", "file", "offset").toArrow()
    shared = keys.sparkSession.sparkContext.broadcast([blocks[n].to_pylist() for n in names])
    kinds = [(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in ENTRIES.split(", "))]

    @F.arrow_udf("array<int>")
    def holding(column: pa.Array) -> pa.Array:
        firsts, lasts = shared.value[:2]
        return pa.array([list(range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))) for k in column.to_pylist()], pa.list_(pa.int32()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, number, rows, at = list(zip(*shared.value[2:], strict=True)), None, [], []
        for batch in batches:
            hit = []
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != number:
                    number, data = block, next(ranges(folder, [places[block]]))
                    rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                    at = [r["urlkey"] for r in rows]
                hit += rows[bisect.bisect_left(at, key) : bisect.bisect_right(at, key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in hit], k) for n, k in kinds], [n for n, _ in kinds])

    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select("urlkey").where("urlkey IS NOT NULL").distinct().select("urlkey", F.explode(holding("urlkey")).alias("block"))
    return wanted.repartition(tasks, "block").sortWithinPartitions("block", "urlkey").mapInArrow(find, ENTRIES)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives and index of `pages`, looks up every page's URL in the index and reads its records back: READ."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    directory = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    found = lookup(pages.select(url_key(F.col("url")).alias("urlkey")), directory, f"{folder}/index")
    return read_records(found, f"{folder}/archives")
