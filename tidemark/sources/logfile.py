"""Growing text logs as a data source, for batches and streams: whole lines with the byte they begin at.

``spark.dataSource.register(LogSource)`` once, then ``spark.read.format("log").load(path)`` or ``readStream``.  A file is
read in stretches of ``split`` bytes, each line by the stretch that it begins in, so order and content don't depend
on the stretches.  The bytes after the last line feed are a line that is still being written: it comes once it is whole.
Paths are those of pyarrow's file systems, such as local or mounted folders, ``hdfs://`` and ``s3://``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT, BLOCK = 64 << 20, 1 << 20
ROWS = 10_000


class Stretch(InputPartition):
    def __init__(self, file: str, low: int, high: int) -> None:
        self.file, self.low, self.high = file, low, high


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The files of a folder in order, or the one file; names that begin with ``_`` or ``.`` are no logs."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")
    return system, [at] if info.type == fs.FileType.File else []


def whole_until(system: fs.FileSystem, file: str, since: int = 0) -> int:
    """Where the last whole line of a file ends; ``since`` is known to be an end of a line."""
    with system.open_input_file(file) as f:
        high = f.size()
        while high > since:
            low = max(since, high - BLOCK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return since


def stretches(ends: dict[str, int], begins: dict[str, int], split: int) -> list[Stretch]:
    return [Stretch(file, low, min(low + split, end)) for file, end in sorted(ends.items()) for low in range(begins.get(file, 0), end, split)]


def lines_of(system: fs.FileSystem, part: Stretch) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a stretch, with the byte each begins at; a line that begins there is read to its end."""
    with system.open_input_file(part.file) as f:
        at = part.low
        if at:  # the line that runs into the stretch is that of an earlier one
            f.seek(at - 1)
            while True:
                block = f.read(BLOCK)
                if not block:
                    return
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut
                    break
                at += len(block)
        f.seek(at)
        held: list[bytes] = []
        while at < part.high:
            block = f.read(BLOCK)
            if not block:
                return
            *whole, rest = block.split(b"\n")
            for line in whole:
                line = b"".join([*held, line])
                held = []
                yield at, line
                at += len(line) + 1
                if at >= part.high:
                    return
            held.append(rest)


def _batches(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    system, _ = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    rows: list[tuple[int, str]] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [part.file] * len(rows), "offset": [r[0] for r in rows], "line": [r[1] for r in rows]}, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())]))

    size = 0
    for at, line in lines_of(system, part):
        rows.append((at, line.decode("utf-8", "replace")))
        size += len(line)
        if len(rows) >= ROWS or size >= 16 * BLOCK:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Stretch]:
        system, found = files_of(self.path)
        return stretches({f: whole_until(system, f) for f in found}, {}, self.split) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _batches(self.path, partition)


class LogStream(DataSourceStreamReader):
    """An offset is the end of the last whole line of every file."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ends": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        system, found = files_of(self.path)
        self.known = {f: whole_until(system, f, self.known.get(f, 0)) for f in found}
        return {"ends": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(json.loads(end["ends"]), json.loads(start["ends"]), self.split)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``file string, offset long, line string``; options ``path`` and ``split`` (bytes of a stretch)."""

    @classmethod
    def name(cls) -> str:
        return "log"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> LogReader:  # noqa: ANN001, ARG002
        return LogReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> LogStream:  # noqa: ANN001, ARG002, N802
        return LogStream(self.options["path"], int(self.options.get("split", SPLIT)))
