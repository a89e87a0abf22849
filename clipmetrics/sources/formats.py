"""Landed result lines and subtitle files as Spark formats: spark.read.format("landed_lines"), .format("subtitles").

register_formats makes them known to a session. Paths may be plain or any address that Arrow's file systems open; driver
and executors must both reach them.
"""

from __future__ import annotations

import io
import json
import operator
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from clipmetrics import schemas
from clipmetrics.session import ship_package

LINES = f"file string, at bigint, {schemas.JSONL_ROW}"
SUBTITLES = "video string, part bigint, content string"
SPLIT_BYTES = 64 << 20
MEMBER_BYTES = 1 << 20
ROWS = 4096
_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[fs.FileInfo]:
    """Files below a path by name; hidden ones (not yet committed, or marks) are left out."""
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda f: any(part[0] in "._" for part in PurePosixPath(f.path).relative_to(root).parts)
    return sorted((f for f in found if f.is_file and not hidden(f)), key=lambda f: f.path)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """rows in batches of bounded number and text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= ROWS or weight >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


@dataclass
class Span(ds.InputPartition):
    """The lines of a file that begin in a byte range."""

    file: str
    start: int
    end: int


def _spans(files: list[fs.FileInfo], split: int) -> list[Span]:
    return [Span(f.path, at, min(at + split, f.size)) for f in files for at in range(0, f.size, split)]


def _line_rows(system: fs.FileSystem, span: Span, fields: list[tuple[str, str]], tests: list[tuple[str, Callable]]) -> Iterator[tuple]:
    """Rows of a span. Lines that are no JSON object are left out; a value of another type than the field's is null."""
    with system.open_input_file(span.file) as raw, io.BufferedReader(raw, 1 << 20) as lines:
        at = max(0, span.start - 1)
        lines.seek(at)
        if span.start:
            at += len(lines.readline())  # the rest of a line that begins in the span before
        while at < span.end and (line := lines.readline()):
            began, at = at, at + len(line)
            try:
                said = json.loads(line)
            except ValueError:
                continue
            if not isinstance(said, dict):
                continue
            row = {"file": span.file, "at": began}
            for name, kind in fields:
                value = said.get(name)
                fits = isinstance(value, str) if kind == "string" else isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63
                row[name] = value if fits else None
            if all(test(row[name]) for name, test in tests):
                yield tuple(row.values())


class _Lines:
    def __init__(self, path: str, split: int, schema: pa.Schema) -> None:
        self.path, self.split, self.schema = path, split, schema
        self.fields = [tuple(f.split(" ")) for f in schemas.JSONL_ROW.split(", ")]
        self.tests: list[tuple[str, Callable]] = []

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # Spark asks once also where there is no partition
            return iter(())
        system, _ = _opened(self.path)
        texts = lambda row: sum(len(v) for v in row if isinstance(v, str))
        return _batches(_line_rows(system, span, self.fields, self.tests), self.schema, texts)


class LinesReader(_Lines, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Comparisons of a column with a value, membership and null tests are answered here; the rest stays Spark's."""
        for wanted in filters:
            name = wanted.attribute[0] if len(getattr(wanted, "attribute", ())) == 1 else None
            if name is None:
                yield wanted
            elif (compare := _COMPARE.get(type(wanted))) is not None:
                self.tests.append((name, lambda v, c=compare, to=wanted.value: v is not None and c(v, to)))
            elif isinstance(wanted, ds.In):
                self.tests.append((name, frozenset(v for v in wanted.value if v is not None).__contains__))
            elif isinstance(wanted, ds.IsNotNull):
                self.tests.append((name, lambda v: v is not None))
            else:
                yield wanted

    def partitions(self) -> list[Span]:
        return _spans(_listed(self.path), self.split)


class LinesStream(_Lines, ds.DataSourceStreamReader):
    """Files in order of their last change. A file counts once it has not changed for settle_seconds; it is not read again."""

    def __init__(self, path: str, split: int, schema: pa.Schema, settle: float) -> None:
        super().__init__(path, split, schema)
        self.settle_ns = int(settle * 1e9)

    def initialOffset(self) -> dict:
        return {"after": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.settle_ns
        return {"after": max((f.mtime_ns for f in _listed(self.path) if f.mtime_ns <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans([f for f in _listed(self.path) if start["after"] < f.mtime_ns <= end["after"]], self.split)

    def commit(self, end: dict) -> None:
        pass


class LandedLines(ds.DataSource):
    """JSON-line results as landed, with file and byte position. Options: split_bytes, and for streams settle_seconds."""

    @classmethod
    def name(cls) -> str:
        return "landed_lines"

    def schema(self) -> str:
        return LINES

    def _args(self, schema: StructType) -> tuple[str, int, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        if schema.fieldNames() != [f.split(" ")[0] for f in LINES.split(", ")]:
            raise ValueError("landed_lines has a schema of its own; select from it")
        return self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), to_arrow_schema(schema)

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(*self._args(schema))

    def streamReader(self, schema: StructType) -> LinesStream:
        return LinesStream(*self._args(schema), float(self.options.get("settle_seconds", 2)))


@dataclass
class Files(ds.InputPartition):
    files: list[str]


class SubtitleReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema) -> None:
        self.path, self.arrow = path, schema

    def partitions(self) -> list[Files]:
        """Many small files make one task; an archive is read by one."""
        groups, size = [], SPLIT_BYTES
        for f in (f for f in _listed(self.path) if f.path.endswith((".srt", ".tar"))):
            if size + f.size > SPLIT_BYTES:
                groups.append(Files([]))
                size = 0
            groups[-1].files.append(f.path)
            size += f.size
        return groups

    def _rows(self, files: list[str]) -> Iterator[tuple]:
        system, root = _opened(self.path)
        for path in files:
            with system.open_input_stream(path) as raw:
                if path.endswith(".srt"):
                    yield str(PurePosixPath(path).relative_to(root).with_suffix("")), 0, raw.read().decode("utf-8", "replace")
                    continue
                with tarfile.open(fileobj=raw, mode="r|") as archive:
                    for member in archive:
                        video, _, part = member.name.removesuffix(".srt").rpartition("/")
                        yield unquote(video), int(part), archive.extractfile(member).read().decode("utf-8", "replace")

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return _batches(self._rows(partition.files if partition else []), self.arrow, lambda row: len(row[2]))


@dataclass
class Archived(ds.WriterCommitMessage):
    staged: str | None


class SubtitleWriter(ds.DataSourceArrowWriter):
    """Rows in order of video and part; neighbours of one video are joined to members of at most about MEMBER_BYTES.

    A task writes one hidden archive of its own, which the commit names; what failed tasks leave behind is never read.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archived:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("video", "part", "content"))))
        first = next(rows, None)
        if first is None:
            return Archived(None)
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        staged = f"{root.rstrip('/')}/_{uuid.uuid4().hex}.tar"
        with system.open_output_stream(staged) as out, tarfile.open(fileobj=out, mode="w|") as archive:
            video, part, held, size = first[0], first[1], [first[2]], len(first[2])
            for name, number, content in rows:
                if name != video or size >= MEMBER_BYTES:
                    self._add(archive, video, part, held)
                    video, part, held, size = name, number, [], 0
                held.append(content)
                size += len(content)
            self._add(archive, video, part, held)
        return Archived(staged)

    @staticmethod
    def _add(archive: tarfile.TarFile, video: str, part: int, contents: list[str]) -> None:
        data = "\n".join(contents).encode()
        member = tarfile.TarInfo(f"{quote(video, safe='')}/{part:012d}.srt")
        member.size = len(data)
        archive.addfile(member, io.BytesIO(data))

    def commit(self, messages: list[Archived | None]) -> None:
        system, _ = _opened(self.path)
        for staged in (m.staged for m in messages if m and m.staged):
            folder, _, name = staged.rpartition("/")
            system.move(staged, f"{folder}/part-{name[1:]}")

    def abort(self, messages: list[Archived | None]) -> None:
        system, _ = _opened(self.path)
        for staged in (m.staged for m in messages if m and m.staged):
            if system.get_file_info(staged).is_file:
                system.delete_file(staged)


class Subtitles(ds.DataSource):
    """Subtitle texts below a folder: plain .srt files, and archives of many videos, which is also how they are written."""

    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SUBTITLES

    def reader(self, schema: StructType) -> SubtitleReader:
        from pyspark.sql.pandas.types import to_arrow_schema
        return SubtitleReader(self.options["path"], to_arrow_schema(schema))

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        if overwrite:
            raise ValueError("subtitles are only appended; write to a new folder")
        return SubtitleWriter(self.options["path"])


def register_formats(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedLines)
    spark.dataSource.register(Subtitles)
