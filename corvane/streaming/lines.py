"""Lines that devices print, as a streaming data source that reopens its connections.

    spark.dataSource.register(lines.DeviceLines)
    spark.readStream.format("devicelines").option("devices", "d0=host:port,d1=host:port").option("spool", folder).load()

A thread listens to all devices and notes when each line comes. A turn, `poll` seconds after the last, writes what they
have printed to a numbered file in the spool, a folder that all executors share; an offset is the number of such files, so a turn can be read again, by
tasks, after anything is lost. A connection that cannot be made or breaks is tried again each half second;
a line that it cuts is left out. Lines have the time of their arrival. Started anew on its checkpoint, the source
goes on numbering files and lines where the spool ends.
"""

from __future__ import annotations

import json
import select
import socket
import threading
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corvane.sources.archives import store_of
from corvane.streaming.device import TIMED_LINES

RETRY_SECONDS = 0.5


class Turn(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Connection:
    """A device's socket, open or waiting to be tried again, and the bytes of a line that is not complete."""

    def __init__(self, name: str, address: str):
        self.name = name
        host, _, port = address.rpartition(":")
        self.address, self.socket, self.rest, self.again = (host, int(port)), None, b"", 0.0

    def opened(self) -> bool:
        if self.socket is None and time.monotonic() >= self.again:
            try:
                self.socket, self.rest = socket.create_connection(self.address, timeout=RETRY_SECONDS), b""
                self.socket.setblocking(False)
            except OSError:
                self.again = time.monotonic() + RETRY_SECONDS
        return self.socket is not None

    def lines(self) -> list[str]:
        try:
            data = self.socket.recv(1 << 16)
        except OSError:
            data = b""
        if not data:  # the device has gone
            self.socket.close()
            self.socket, self.again = None, time.monotonic() + RETRY_SECONDS
            return []
        *whole, self.rest = (self.rest + data).split(b"\n")
        return [x.decode("utf-8", "replace").rstrip("\r") for x in whole]


class LineReader(DataSourceStreamReader):
    def __init__(self, options):
        devices = (x.partition("=") for x in options["devices"].split(","))
        self.connections = [Connection(name, address) for name, _, address in devices]
        self.spool, self.poll = options["spool"], float(options.get("poll", 0.5))
        self.turn: int | None = None
        self.next_line: dict[str, int] = {}
        self.spooled: dict[str, int] = {}
        self.heard: list[tuple] = []
        self.listener: threading.Thread | None = None
        self.lock, self.ended, self.failed = threading.Lock(), threading.Event(), None

    def __getstate__(self):
        """What tasks need: they read the spool only."""
        return {"spool": self.spool}

    def __setstate__(self, state):
        self.spool = state["spool"]

    def listen(self) -> None:
        try:
            while not self.ended.is_set():
                own = {c.socket: c for c in self.connections if c.opened()}
                if not own:
                    time.sleep(0.05)
                    continue
                for ready in select.select(list(own), [], [], 0.05)[0]:
                    for line in own[ready].lines():
                        with self.lock:
                            name = own[ready].name
                            number = self.next_line.get(name, 0)
                            self.next_line[name] = number + 1
                            self.heard.append((name, number, time.time(), line))
        except Exception as e:  # told by the next turn
            self.failed = e

    def path(self, number: int) -> str:
        return f"{store_of(self.spool)[1]}/{number:012d}.json"

    def resume(self) -> None:
        """Where the spool ends."""
        from pyarrow import fs

        store, base = store_of(self.spool)
        store.create_dir(base, recursive=True)
        numbers = [int(f.base_name[:12]) for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".json")]
        self.turn = max(numbers, default=0)
        if self.turn:
            with store.open_input_stream(self.path(self.turn)) as f:
                self.spooled = json.loads(f.read())["next_line"]
                self.next_line = dict(self.spooled)

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def latestOffset(self) -> dict:
        if self.turn is None:
            self.resume()
            if self.turn:  # what was spooled and perhaps not read comes first
                return {"turn": self.turn}
        if self.listener is None:
            self.listener = threading.Thread(target=self.listen, daemon=True)
            self.listener.start()
        time.sleep(self.poll)
        with self.lock:
            rows, self.heard = self.heard, []
        if self.failed is not None:
            raise RuntimeError("the listening thread has ended") from self.failed
        if rows:
            self.turn += 1
            store, _ = store_of(self.spool)
            for name, number, _, _ in rows:
                self.spooled[name] = number + 1
            with store.open_output_stream(f"{self.path(self.turn)}.part") as f:
                f.write(json.dumps({"next_line": self.spooled, "rows": rows}).encode())
            store.move(f"{self.path(self.turn)}.part", self.path(self.turn))
        return {"turn": self.turn}

    def partitions(self, start: dict, end: dict):
        return [Turn(n) for n in range(start["turn"] + 1, end["turn"] + 1)]

    def read(self, partition):
        store, _ = store_of(self.spool)
        with store.open_input_stream(self.path(partition.number)) as f:
            for row in json.loads(f.read())["rows"]:
                yield tuple(row)

    def commit(self, end: dict) -> None:
        """Spooled turns stay: they are the record of the run."""

    def stop(self) -> None:
        self.ended.set()
        if self.listener is not None:
            self.listener.join()
        for c in self.connections:
            if c.socket is not None:
                c.socket.close()


class DeviceLines(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "devicelines"

    def schema(self) -> str:
        return TIMED_LINES

    def streamReader(self, schema):
        return LineReader(self.options)
