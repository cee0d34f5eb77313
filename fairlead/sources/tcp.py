"""Lines of a TCP feed as a stream that can be replayed and that survives lost connections.

What is received is put into a spool before it is offered, a file for each read named
by the number of its first line; the offset is the number of lines so far.  A batch
that is tried again is read from the spool, and its files go when it is committed.
Between reads the sender waits, so nothing is buffered without bound here.  A
connection that breaks is made again, first at once and then at longer intervals; a
line that it cut is left out.  The spool lies in a folder that the driver reaches by
``pyarrow.fs``: a path, or an address of a shared store.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

NAME = "fairlead-lines"
#: Lines and seconds of a read at most, and the longest pause before a new connection.
LINES, SECONDS, PAUSE = 10_000, 1.0, 30.0


class Lines(DataSource):
    """Options: host, port, spool; lines and seconds of a read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source string, value string"

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.address = options["host"], int(options["port"])
        self.source = f"tcp://{self.address[0]}:{self.address[1]}"
        self.store, self.folder = fs.FileSystem.from_uri(options["spool"])
        self.lines, self.seconds = int(options.get("lines", LINES)), float(options.get("seconds", SECONDS))
        self.link: socket.socket | None = None
        self.rest, self.pause, self.again = b"", 0.0, 0.0

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _spooled(self) -> list[tuple[int, str]]:
        self.store.create_dir(self.folder, recursive=True)
        files = self.store.get_file_info(fs.FileSelector(self.folder))
        return sorted((int(f.base_name[:-6]), f.path) for f in files if f.base_name.endswith(".lines"))

    def _content(self, path: str) -> list[str]:
        with self.store.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", "replace").split("\n")[:-1]

    def _connect(self) -> None:
        if self.link is None and time.monotonic() >= self.again:
            try:
                self.link = socket.create_connection(self.address, timeout=self.seconds)
                self.pause = 0.0
            except OSError:
                self._lost()

    def _lost(self) -> None:
        """A new connection is tried at once, then after pauses that double."""
        if self.link is not None:
            self.link.close()
        self.link, self.rest = None, b""
        self.again = time.monotonic() + self.pause
        self.pause = min(PAUSE, 2 * self.pause or 0.1)

    def _received(self) -> list[str]:
        """Whole lines that come within the time of a read."""
        found: list[str] = []
        end = time.monotonic() + self.seconds
        while len(found) < self.lines and (left := end - time.monotonic()) > 0:
            self._connect()
            if self.link is None:
                time.sleep(min(left, 0.05))
                continue
            try:
                self.link.settimeout(left)
                data = self.link.recv(1 << 16)
            except TimeoutError:
                break
            except OSError:
                data = b""
            if not data:
                self._lost()
                continue
            *whole, self.rest = (self.rest + data).split(b"\n")
            found += [x.decode("utf-8", "replace").rstrip("\r") for x in whole]
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["line"]
        left = dict(self._spooled()).get(first)  # received before a failure, and not offered in any batch since
        lines = self._content(left) if left else self._received()
        if lines and not left:
            with self.store.open_output_stream(f"{self.folder}/{first:020d}.part") as stream:
                stream.write(("\n".join(lines) + "\n").encode())
            self.store.move(f"{self.folder}/{first:020d}.part", f"{self.folder}/{first:020d}.lines")
        return iter([(self.source, x) for x in lines]), {"line": first + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for first, path in self._spooled():
            if start["line"] <= first < end["line"]:
                for line in self._content(path):
                    yield self.source, line

    def commit(self, end: dict) -> None:
        for first, path in self._spooled():
            if first < end["line"]:
                self.store.delete_file(path)
