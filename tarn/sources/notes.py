"""Markdown notes in folders as a data source of Spark: ``spark.read.format("notes")`` and ``df.write.format("notes")``.

Reading lists the files below a folder once, on the driver, and deals them to tasks by their bytes. Conditions on ``path`` and
``modified`` are taken at the listing, so files that they leave out are never opened. Names that begin with a dot or an underscore
are not notes.

Writing has two phases. Tasks write their notes to a staging folder beside the target, each attempt to a part of its own.
The commit puts the parts of the attempts that succeeded in place: a whole new folder by one rename, or, when appending, a
rename a part. A write that fails or is aborted leaves the target as it was and no staging folder.

Paths are URIs of any file system that pyarrow knows (``file://``, ``hdfs://``, ``s3://``, ``gs://``); Python workers and the driver
must reach them. Defined results: an empty or missing folder has no notes; bytes that are no UTF-8 are replaced; a null content
is an empty note; notes without a name are an error; names may hold folders, but no step upwards.
"""

from __future__ import annotations

import datetime
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "path string, slug string, modified timestamp, size long, content string"
#: Bytes that a task reads, what opening a file counts as, and rows and bytes of a batch.
SPLIT_BYTES, OPEN_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 64 << 10, 1000, 4 << 20


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


@dataclass
class _Part(ds.InputPartition):
    files: list[tuple[str, datetime.datetime, int]]


def _value(x):
    """A bound of ``modified`` as Spark hands it over, in UTC."""
    return x.astimezone(datetime.UTC) if isinstance(x, datetime.datetime) and x.tzinfo else x.replace(tzinfo=datetime.UTC) if isinstance(x, datetime.datetime) else x


_TESTS = {
    ds.EqualTo: lambda a, b: a == b,
    ds.In: lambda a, b: a in b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
}


class NotesReader(ds.DataSourceReader):
    def __init__(self, options):
        self.uri, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".md")
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Take what the listing can tell; the rest is left to Spark."""
        for f in filters:
            attribute = getattr(f, "attribute", ())
            if type(f) in _TESTS and attribute in (("path",), ("modified",), ("slug",)):
                value = f.value if type(f) is not ds.In else tuple(f.value)
                self.tests.append((attribute[0], type(f), tuple(map(_value, value)) if isinstance(value, tuple) else _value(value)))
            elif not (type(f) is ds.IsNotNull and attribute in (("path",), ("modified",), ("slug",), ("size",), ("content",))):
                yield f

    def partitions(self):
        """Files that pass, in the order of their paths, as many a task as make up ``splitBytes``."""
        system, root = _at(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = []
        for info in sorted(found, key=lambda i: i.path):
            relative = info.path[len(root) :].strip("/")
            hidden = any(step[0] in "._" for step in relative.split("/") if step)
            if info.type != fs.FileType.File or hidden or not relative.endswith(self.suffix):
                continue
            modified = info.mtime if info.mtime.tzinfo else info.mtime.replace(tzinfo=datetime.UTC)
            known = {"path": relative, "modified": modified, "slug": posixpath.basename(relative)[: -len(self.suffix)]}
            if all(_TESTS[kind](known[name], value) for name, kind, value in self.tests):
                files.append((relative, modified, info.size))
        parts, held, total = [], [], 0
        for f in files:
            if held and total + f[2] + OPEN_BYTES > self.split_bytes:
                parts.append(_Part(held))
                held, total = [], 0
            held.append(f)
            total += f[2] + OPEN_BYTES
        return [*parts, _Part(held)] if held or not parts else parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, root = _at(self.uri)
        rows, size = [], 0
        for relative, modified, n in partition.files:
            with system.open_input_stream(f"{root}/{relative}") as f:
                content = f.read().decode("utf-8", "replace")
            rows.append((relative, posixpath.basename(relative)[: -len(self.suffix)], modified, n, content))
            size += n
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "slug", "modified", "size", "content"])


@dataclass
class _Written(ds.WriterCommitMessage):
    folder: str
    notes: int


class NotesWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        if not {"slug", "content"} <= set(schema.fieldNames()):
            raise ValueError("notes are written from columns slug and content")
        self.uri, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ".md"), overwrite
        parent, name = posixpath.split(_at(self.uri)[1])
        self.staging = f"{parent}/.{name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, _ = _at(self.uri)
        folder, n, made = f"part-{uuid.uuid4().hex}", 0, set()
        for batch in iterator:
            for slug, content in zip(batch.column("slug").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not slug or slug.startswith("/") or any(step in ("", ".", "..") or step[0] in "._" for step in slug.split("/")):
                    raise ValueError(f"no name for a note: {slug!r}")
                path = f"{self.staging}/{folder}/{slug}{self.suffix}"
                if posixpath.dirname(path) not in made:
                    system.create_dir(posixpath.dirname(path), recursive=True)
                    made.add(posixpath.dirname(path))
                with system.open_output_stream(path) as f:
                    f.write((content or "").encode())
                n += 1
        return _Written(folder, n)

    def commit(self, messages) -> None:
        system, root = _at(self.uri)
        kept = {m.folder for m in messages if m is not None and m.notes}
        there = system.get_file_info(fs.FileSelector(self.staging, allow_not_found=True))
        for info in there:
            if posixpath.basename(info.path) not in kept:
                system.delete_dir(info.path)  # attempts that lost
        system.create_dir(self.staging, recursive=True)
        exists = system.get_file_info(root).type != fs.FileType.NotFound
        if self.overwrite or not exists:
            old = f"{self.staging}.old"
            if exists:
                system.move(root, old)
            system.move(self.staging, root)
            if exists:
                system.delete_dir(old)
            return
        for folder in sorted(kept):
            system.move(f"{self.staging}/{folder}", f"{root}/{folder}")
        system.delete_dir(self.staging)

    def abort(self, messages) -> None:
        system, _ = _at(self.uri)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


class NotesSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NotesReader:
        return NotesReader(self.options)

    def writer(self, schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take conditions."""
    spark.dataSource.register(NotesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """``path, slug, modified, size, content`` of the notes below a folder; ``path`` is relative to it."""
    register(spark)
    return spark.read.format("notes").load(path)


def write_notes(notes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``notes (slug, content)`` as files ``<slug>.md`` below ``path``; rows of one name in one part replace each other."""
    register(notes.sparkSession)
    notes.select("slug", "content").write.format("notes").mode(mode).save(path)
