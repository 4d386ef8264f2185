"""Mbox files as a data source: ``spark.read.format("mbox")`` and ``df.write.format("mbox")``.

Read, a message is a row (file, start, raw, error): its bytes as they are, without the
line that begins with ``From `` and the blank line before the next one. A file is cut in
ranges of ``splitBytes``; a range has the messages whose ``From `` line starts in it and reads on to the end
of the last, so that a message across a border is read once. With ``onError=row`` a
file that cannot be read is a row with its error instead of a failed job.

Written, column ``raw`` has a message in each row; lines that begin with ``From `` get a ``>``. Files appear
when the job commits. Paths are local (shared) ones or URIs that pyarrow opens.
"""

from __future__ import annotations

import glob
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, start long, raw binary, error string"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("raw", pa.binary()), ("error", pa.string())])
MARK = b"From "
BATCH = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files, or of a local pattern."""
    store, inner = opened(path)
    if "*" in inner and isinstance(store, fs.LocalFileSystem):
        found = store.get_file_info(sorted(glob.glob(inner)))
    else:
        info = store.get_file_info(inner)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    if any(i.type == fs.FileType.NotFound for i in found) or not found:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[:1] not in "._")


def messages(stream: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the messages whose ``From `` line starts in [start, end)."""
    at = max(0, start - 1)
    stream.seek(at)
    if start:
        at += len(stream.readline())  # the rest of the line that the range before has; a blank one if the border is a line's start
    begun, lines = None, []
    while True:
        line = stream.readline()
        if line.startswith(MARK) or not line:
            if begun is not None:
                if lines and lines[-1] == b"\n":
                    lines.pop()
                yield begun, b"".join(lines)
            if not line or at >= end:
                return
            begun, lines = at, []
        elif begun is not None:
            lines.append(line)
        elif at >= end:
            return
        at += len(line)


@dataclass
class MailRange(InputPartition):
    file: str
    start: int
    end: int
    error: str | None = None


class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.rows = options["path"], int(options.get("splitbytes", 64 << 20)), options.get("onerror", "fail").lower() == "row"

    def partitions(self) -> list[MailRange]:
        try:
            found = files_of(self.path)
        except OSError as e:
            if not self.rows:
                raise
            return [MailRange(self.path, 0, 0, str(e))]
        return [MailRange(f, a, min(a + self.split, size)) for f, size in found for a in range(0, size, self.split)] or [MailRange("", 0, 0)]

    def read(self, partition: MailRange) -> Iterator[pa.RecordBatch]:
        rows, size, error = [], 0, partition.error
        if partition.file and not error:
            try:
                store, inner = opened(partition.file)
                with store.open_input_file(inner) as f, io.BufferedReader(f, 1 << 20) as stream:
                    for start, raw in messages(stream, partition.start, partition.end):
                        rows.append((partition.file, start, raw, None))
                        size += len(raw)
                        if size >= BATCH:
                            yield _batch(rows)
                            rows, size = [], 0
            except OSError as e:
                if not self.rows:
                    raise
                error = str(e)
        if error:
            rows.append((partition.file, partition.start, None, error))
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)


@dataclass
class MailFile(WriterCommitMessage):
    temporary: str
    final: str


class MboxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> MailFile:
        store, inner = opened(self.path)
        store.create_dir(inner, recursive=True)
        name = uuid.uuid4().hex
        made = MailFile(f"{inner}/_{name}", f"{inner}/part-{name}.mbox")
        with store.open_output_stream(made.temporary) as out:
            for batch in iterator:
                for raw in batch.column("raw").to_pylist():
                    body = (b"\n" + (raw or b"").removesuffix(b"\n")).replace(b"\n" + MARK, b"\n>" + MARK)
                    out.write(MARK + b"- Thu Jan  1 00:00:00 1970" + body + b"\n\n")
        return made

    def commit(self, made: list[MailFile | None]) -> None:
        store, inner = opened(self.path)
        if self.overwrite:
            for path, _ in files_of(self.path):
                store.delete_file(opened(path)[1])
        for one in filter(None, made):
            store.move(one.temporary, one.final)

    def abort(self, made: list[MailFile | None]) -> None:
        store, _ = opened(self.path)
        for one in filter(None, made):
            store.delete_file(one.temporary)


class MboxSource(DataSource):
    """Options: path, splitBytes (64 MB), onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)

    def writer(self, schema, overwrite: bool) -> MboxWriter:
        return MboxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MboxSource)
