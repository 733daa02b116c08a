"""E5: a pluggable collector as a Python data source, ``payload_pages``.

A collector drops pages into a folder, one JSON payload a line, as an API hands
them out; the records are a list (or one object) under a dotted path of the page.
``spark.read.format("payload_pages")`` reads them in partitions of bounded size
(byte ranges of the files; a page belongs to the range it begins in), and
``spark.readStream`` reads what landed since the last offset.

Options: ``path``; ``records`` (dotted path, default ``data``); ``split_bytes``.
The columns are those of the schema that the reader is given, all text, looked up by
name; a value that is not text comes as JSON.  Without a schema there is one column
``record``.  A page that is no JSON, or has nothing under the path, stops the read,
unless the schema has a column ``_corrupt_record``, which then holds the page.

Offsets are the last file name read; a poll's files must sort after those of the
polls before it (:func:`landing_name`).  Paths are any that pyarrow's file systems open.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructType

SPLIT_BYTES = 32 << 20
ROWS = 4096  # of a batch handed to the engine
CORRUPT = "_corrupt_record"


def landing_name(poll: int) -> str:
    """Sub-folder of a poll; later polls sort behind."""
    return f"poll-{poll:09d}"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def list_files(path: str) -> list[tuple[str, int]]:
    """(name below the folder, bytes), sorted; hidden files and folders are left out."""
    fs, root = open_folder(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    base = os.path.normpath(root)
    names = [(os.path.relpath(f.path, base), f.size) for f in found if f.type == pafs.FileType.File]
    return sorted((n, size) for n, size in names if size and not any(p.startswith(("_", ".")) for p in n.split("/")))


class Range(InputPartition):
    """Pages that begin in [start, end) of a file."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def ranges(files: list[tuple[str, int]], split: int) -> list[Range]:
    return [Range(name, at, min(at + split, size)) for name, size in files for at in range(0, size, split)]


def pages(path: str, part: Range) -> Iterator[bytes]:
    fs, root = open_folder(path)
    with io.BufferedReader(fs.open_input_file(os.path.join(root, part.name)), 1 << 20) as f:
        at = part.start
        if at:  # the page before began in the range before; a range that starts with a page has a line end before it
            f.seek(at - 1)
            skipped = f.readline()
            at += len(skipped) - 1
        while at < part.end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            if line.strip():
                yield line


def records(page: bytes, dotted: str) -> list:
    """The records under the path; ValueError if there is nothing."""
    node = json.loads(page)
    for key in filter(None, dotted.split(".")):
        if not isinstance(node, dict) or key not in node:
            raise ValueError(f"no {dotted!r} in the page")
        node = node[key]
    return node if isinstance(node, list) else [node]


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class _Pages:
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.dotted = options.get("records", "data")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.columns = schema.fieldNames()
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("payload_pages hands out text columns only")

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder has no ranges
            return
        rows: list[dict] = []
        for page in pages(self.path, partition):
            try:
                found = records(page, self.dotted)
            except ValueError:
                if CORRUPT not in self.columns:
                    raise
                found = [{CORRUPT: page.decode("utf-8", "replace").rstrip("\n")}]
            rows += [r if isinstance(r, dict) else {"record": r} for r in found] if self.columns != ["record"] else \
                [{"record": json.dumps(r)} for r in found]
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                rows = rows[ROWS:]
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([_text(r.get(c)) for r in rows], pa.string()) for c in self.columns], names=self.columns)


class PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(list_files(self.path), self.split)


class PagesStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([f for f in list_files(self.path) if start["last"] < f[0] <= end["last"]], self.split)

    def commit(self, end: dict) -> None:
        """Landed files stay; the checkpoint holds the offset."""


class PayloadPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_pages"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagesStreamReader:
        return PagesStreamReader(self.options, schema)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadPages)
