"""Folders as a Spark data source: ``spark.read.format("tree")`` gives the inventory of source trees, ``df.write.format("tree")`` makes them.

A tree is read without following a link: entries are files, directories, symbolic links with their targets, and what is neither.  Unlike
the reader of binary files it tells permissions and links, and keeps files without bytes.  The folder must be mounted where the driver and all
executors run; trees in an object store go through :func:`treelift.sources.archives.folder_inventory`.

Options: path (a folder), source_id (its name; without it, every folder in path is a source), max_file, max_depth, max_entries
(of one folder), partitions (folders are dealt to about as many tasks).
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from treelift.sources.archives import INVENTORY, MAX_DEPTH, MAX_ENTRIES, MAX_FILE, VCS, text_or_none, unsafe_path

BATCH_BYTES = 8 << 20
_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in INVENTORY.split(", ")])


def local_path(path: str) -> str:
    """A path of a mounted folder, given as such or as a file: URL."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"the tree source reads mounted folders, not {path}")
    return os.path.abspath(path)


@dataclass
class Folder(InputPartition):
    """Folders of one source that a task reads, each with or without what lies below."""

    source_id: str
    root: str
    folders: list[tuple[str, bool]]


def _name_or_none(name: str) -> str | None:
    """A name that is text."""
    try:
        name.encode("utf-8")
    except UnicodeEncodeError:
        return None
    return name


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        number = lambda name, default: int(options.get(name, default))
        self.root, self.source_id = local_path(options["path"]), options.get("source_id")
        self.max_file, self.max_depth = number("max_file", MAX_FILE), number("max_depth", MAX_DEPTH)
        self.max_entries, self.wanted = number("max_entries", MAX_ENTRIES), number("partitions", 64)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level, until there are enough of them; a folder that was opened is read alone, the others with all below."""
        if self.source_id is not None:
            sources = [(self.source_id, self.root)]
        else:
            with os.scandir(self.root) as found:
                sources = sorted((e.name, e.path) for e in found if e.is_dir(follow_symlinks=False) and e.name not in VCS)
        share = max(1, self.wanted // max(1, len(sources)))
        return [Folder(name, root, part) for name, root in sources for part in self._shared_out(root, share)]

    def _shared_out(self, root: str, share: int) -> list[list[tuple[str, bool]]]:
        opened: list[str] = []
        level = [""]
        while level and len(level) < share and len(opened) < 16 * share:
            below = []
            for folder in level:
                with os.scandir(os.path.join(root, folder)) as found:
                    below += [os.path.join(folder, e.name) for e in found if e.is_dir(follow_symlinks=False) and e.name not in VCS]
            opened += level
            level = below
        parts: list[list[tuple[str, bool]]] = [[] for _ in range(share)]
        for k, item in enumerate([*((f, True) for f in sorted(level)), *((f, False) for f in opened)]):
            parts[k % share].append(item)
        return [p for p in parts if p]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for folder, below in partition.folders:
            for row in self._walk(partition.root, folder, below):
                rows.append((partition.source_id, *row))
                held += 256 + len(row[6] or "")
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _walk(self, root: str, folder: str, below: bool) -> Iterator[tuple]:
        todo = [folder]
        while todo:
            folder = todo.pop()
            try:
                with os.scandir(os.path.join(root, folder)) as found:
                    entries = sorted((e for e in found if e.name not in VCS), key=lambda e: e.name)
            except OSError:
                yield (folder, "unsupported", 0, False, None, None, None, "changed")
                continue
            if len(entries) > self.max_entries:
                yield (folder or ".", "unsupported", len(entries), False, None, None, None, "too_many_entries")
                continue
            for entry in entries:
                path = os.path.join(folder, entry.name)
                row = self._entry(root, path)
                yield row
                if row[1] == "directory" and row[7] is None and below:
                    todo.append(path)

    def _entry(self, root: str, path: str) -> tuple:
        name = _name_or_none(path)
        if name is None or unsafe_path(name):
            return (path.encode("utf-8", "replace").decode(), "unsupported", 0, False, None, None, None, "unsafe_path")
        if path.count("/") >= self.max_depth:
            return (path, "unsupported", 0, False, None, None, None, "too_deep")
        full = os.path.join(root, path)
        try:
            info = os.lstat(full)
            if stat.S_ISLNK(info.st_mode):
                target = os.readlink(full)
                readable = _name_or_none(target)
                return (path, "symlink", len(os.fsencode(target)), False, readable, None, None, None if readable is not None else "unsafe_target")
            if stat.S_ISDIR(info.st_mode):
                return (path, "directory", 0, False, None, None, None, None)
            if not stat.S_ISREG(info.st_mode):
                return (path, "unsupported", 0, False, None, None, None, "unsupported_member")
            if info.st_nlink != 1:
                return (path, "unsupported", info.st_size, False, None, None, None, "hard_link")
            return self._file(full, path)
        except OSError:
            return (path, "unsupported", 0, False, None, None, None, "changed")

    def _file(self, full: str, path: str) -> tuple:
        handle = os.open(full, os.O_RDONLY | os.O_NOFOLLOW)
        with os.fdopen(handle, "rb") as file:
            info = os.fstat(handle)
            data = file.read(self.max_file + 1) if stat.S_ISREG(info.st_mode) and info.st_size <= self.max_file else None
        executable = bool(info.st_mode & 0o111)
        if data is None or len(data) > self.max_file:
            return (path, "file", info.st_size, executable, None, None, None, "too_large")
        return (path, "file", len(data), executable, None, hashlib.sha256(data).hexdigest(), text_or_none(data), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    entries: int


class TreeWriter(DataSourceArrowWriter):
    """Makes trees in a folder beside the wanted one, which takes its name when all tasks are through: all of it appears, or nothing."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.target, self.overwrite = local_path(options["path"]), overwrite
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        for batch in iterator:
            columns = {c: batch.column(c).to_pylist() for c in ("source_id", "path", "kind", "executable", "symlink_target", "content")}
            for source, path, kind, executable, target, content in zip(*columns.values(), strict=True):
                if unsafe_path(source) or "/" in source or unsafe_path(path) or set(path.split("/")) & {"", "."}:
                    raise ValueError(f"not a path in a tree: {source!r}, {path!r}")
                self._make(os.path.join(self.staging, source, path), kind, executable, target, content)
                n += 1
        return Written(n)

    @staticmethod
    def _make(full: str, kind: str, executable: bool, target: str | None, content: str | None) -> None:
        if kind == "directory":
            os.makedirs(full, exist_ok=True)
            return
        os.makedirs(os.path.dirname(full), exist_ok=True)
        part = os.path.join(os.path.dirname(full), f".part-{uuid.uuid4().hex}")  # a task that is run again replaces what it left
        if kind == "symlink":
            os.symlink(target, part)
        else:
            with open(part, "xb") as file:
                file.write((content or "").encode())
            os.chmod(part, 0o755 if executable else 0o644)
        os.replace(part, full)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite and os.path.lexists(self.target):
            os.replace(self.target, f"{self.staging}-old")
        os.rename(self.staging, self.target)
        shutil.rmtree(f"{self.staging}-old", ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, overwrite)


def read_trees(spark: SparkSession, path: str, source_id: str | None = None, **limits: int) -> DataFrame:
    """Inventory rows of the trees in a mounted folder."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").options(**limits)
    return (reader if source_id is None else reader.option("source_id", source_id)).load(path)


def write_trees(inventory: DataFrame, path: str) -> None:
    """Makes the trees of an inventory (source_id, path, kind, executable, symlink_target, content) in a mounted folder."""
    inventory.sparkSession.dataSource.register(TreeSource)
    columns = ["source_id", "path", "kind", "executable", "symlink_target", "content"]
    inventory.select(*columns).write.format("tree").mode("append").save(path)
