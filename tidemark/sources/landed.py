"""Landed payload files as a Spark data source: ``spark.read.format("landed").load(folder)``.

The folder holds ``source=<name>/day=<yyyy-mm-dd>/<file>`` with one payload a line. Rows are (source, day, file, line, payload). Options:
``path``, ``splitBytes`` (files are dealt into splits of about that size, one task each; a file is read by one task, line by line).
Streams of landed files use Spark's own file source. Any store that ``pyarrow.fs`` knows will do; driver and executors must both see it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

SCHEMA = "source string, day date, file string, line long, payload string"
ARROW = pa.schema([("source", pa.string()), ("day", pa.date32()), ("file", pa.string()), ("line", pa.int64()), ("payload", pa.string())])
BATCH_CHARS = 8_000_000
COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass(frozen=True)
class Landed:
    source: str
    day: dt.date
    path: str
    size: int


@dataclass
class Split(InputPartition):
    files: list[Landed]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def folders(fs: pafs.FileSystem, path: str, name: str) -> Iterator[tuple[str, str]]:
    """(value, path) of the folders ``name=value``; a missing folder has none."""
    for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and f.base_name.startswith(name + "="):
            yield unquote(f.base_name.split("=", 1)[1]), f.path


def holds(f: Filter, value) -> bool:
    if isinstance(f, EqualTo):
        return value == f.value
    return value in f.value if isinstance(f, In) else COMPARED[type(f)](value, f.value)


def listing(path: str, filters: Iterable[Filter] = ()) -> list[Landed]:
    """The files of all folders that pass; a folder that a filter rules out is not listed. Names that start with ``_`` or ``.`` are not payloads."""
    fs, root = filesystem(path)
    by = {c: [f for f in filters if f.attribute == (c,)] for c in ("source", "day")}
    out = []
    for source, inner in folders(fs, root, "source"):
        if not all(holds(f, source) for f in by["source"]):
            continue
        for text, leaf in folders(fs, inner, "day"):
            day = dt.date.fromisoformat(text)
            if all(holds(f, day) for f in by["day"]):
                out += [
                    Landed(source, day, f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(leaf))
                    if f.type == pafs.FileType.File and f.base_name[0] not in "_."
                ]
    return out


def splits(files: list[Landed], most: int) -> list[Split]:
    """Files in order of their paths, up to ``most`` bytes a split; a larger file is a split of its own."""
    out, size = [], 0
    for f in sorted(files, key=lambda f: f.path):
        if not out or size + f.size > most:
            out.append(Split([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


def batch(f: Landed, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    columns = [pa.array([f.source] * n), pa.array([f.day] * n, pa.date32()), pa.array([f.path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def read_split(path: str, split: Split) -> Iterator[pa.RecordBatch]:
    """Batches of some eight million characters; compressed files are read by their ending, broken characters become U+FFFD."""
    fs, _ = filesystem(path)
    for f in split.files:
        with fs.open_input_stream(f.path) as raw:
            rows, held, first = [], 0, 0
            for line in raw_lines(raw):
                rows.append(line)
                held += len(line)
                if held >= BATCH_CHARS:
                    yield batch(f, first, rows)
                    rows, held, first = [], 0, first + len(rows)
            if rows:
                yield batch(f, first, rows)


def raw_lines(stream: pa.NativeFile, block: int = 1 << 20) -> Iterator[str]:
    """Lines without their end; the last one needs none."""
    rest: list[bytes] = []
    while data := stream.read(block):
        *whole, last = data.split(b"\n")
        if whole:
            yield (b"".join(rest) + whole[0]).decode("utf-8", "replace")
            for x in whole[1:]:
                yield x.decode("utf-8", "replace")
            rest = []
        rest.append(last)
    tail = b"".join(rest)
    if tail:
        yield tail.decode("utf-8", "replace")


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.filters = options["path"], int(options.get("splitBytes", 128 << 20)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of source and day choose folders; all others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, *COMPARED)) and f.attribute in (("source",), ("day",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        return splits(listing(self.path, self.filters), self.most) or [Split([])]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.path, partition)


class LandedPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPayloads)
