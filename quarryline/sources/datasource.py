"""Spark data sources of our own: ``submissions`` (folders of filings, batch and stream) and ``misses`` (a log with commits).

Register both with ``register(spark)``.  Files are reached through pyarrow's file systems, so a path may be local, shared or in
any store that pyarrow knows; on a cluster it must be one that all executors reach.
"""

from __future__ import annotations

import json
import os
import posixpath
import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FILE = "full-submission.txt"
#: Bytes of files that one task reads, about, a file counting as ``OPEN_BYTES`` more; a larger file is a task of its own.
TASK_BYTES, OPEN_BYTES = 64 << 20, 128 << 10
#: Texts of so many bytes, about, and so many files make a batch of rows.
BATCH_BYTES, BATCH_FILES = 4 << 20, 256
#: Threads that list folders at once.
LISTERS = 8
#: A level of more folders is dealt to tasks by a batch read.
DEALT = 1024


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write under another name and move, so that a reader never sees half a file."""
    folder = posixpath.dirname(path)
    try:
        fs.create_dir(folder, recursive=False)
    except OSError:  # the folder above isn't there yet
        fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _lines(fs: pafs.FileSystem, path: str) -> list[str]:
    with fs.open_input_stream(path) as f:
        return f.read().decode().splitlines()


# --- submissions -----------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __getstate__(self) -> bytes:
        """Paths are much alike, and the driver holds those of all tasks."""
        return zlib.compress(json.dumps(self.paths).encode())

    def __setstate__(self, state: bytes) -> None:
        self.paths = tuple(json.loads(zlib.decompress(state)))


@dataclass
class Folders(Files):
    """Folders whose submissions, at any depth, the task itself lists."""


@dataclass
class _Packed(InputPartition):
    """Files or folders of a task as the planner holds them."""

    folders: bool
    state: bytes

    def part(self) -> Files:
        part = (Folders if self.folders else Files)(())
        part.__setstate__(self.state)
        return part


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of the folders and submissions right in ``folder``; a local one is never held whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                yield from ((f.path, f.is_dir()) for f in found if f.is_dir() or f.name == FILE)
        except FileNotFoundError:
            pass
        return
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if f.type == pafs.FileType.Directory or f.is_file and f.base_name == FILE:
            yield f.path, not f.is_file


def _below(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return [f for f in fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.is_file and f.base_name == FILE]


def _dealt(root: str) -> Iterator[Files]:
    """Tasks for what lies below ``root``.  The first level of more than ``DEALT`` folders is dealt out as it is listed, and tasks list the rest.

    So the planner holds few paths at a time besides the packed ones of the tasks.  The first folder of a task says how many go with it.
    """
    fs, base = open_path(root)
    files, folders = [], [base]
    while folders:
        level = (x for folder in folders for x in _entries(fs, folder))
        folders = []
        for path, is_folder in level:
            (folders if is_folder else files).append(path)
            if len(folders) > DEALT:
                break
        if len(folders) <= DEALT:
            continue
        held, step = [], 0
        for path, is_folder in chain(((x, True) for x in folders), level):
            if not is_folder:
                files.append(path)
                continue
            if not held:
                step = max(1, TASK_BYTES // max(OPEN_BYTES, sum(f.size + OPEN_BYTES for f in _below(fs, path))))
            held.append(path)
            if len(held) >= step:
                yield Folders(tuple(held))
                held = []
        if held:
            yield Folders(tuple(held))
        folders = []
    for lo in range(0, len(files), DEALT):
        yield from _tasks(fs.get_file_info(files[lo : lo + DEALT]))


def _listed(root: str) -> list[pafs.FileInfo]:
    """Submissions below ``root`` by time of change; what lies below the first level of many folders is listed by threads."""
    fs, base = open_path(root)
    look = lambda folder, deep: fs.get_file_info(pafs.FileSelector(folder, recursive=deep, allow_not_found=True))
    below = lambda folder, deep=True: [f for f in look(folder, deep) if f.type == pafs.FileType.Directory and not deep or f.is_file and f.base_name == FILE]
    out, folders = [], [base]
    with ThreadPoolExecutor(LISTERS) as pool:
        while 0 < len(folders) < LISTERS:
            found = [f for own in pool.map(lambda folder: below(folder, False), folders) for f in own]
            out += [f for f in found if f.is_file]
            folders = [f.path for f in found if not f.is_file]
        for own in pool.map(below, folders):
            out += own
    return sorted(out, key=lambda f: (f.mtime_ns or 0, f.path))


def _tasks(files: list[pafs.FileInfo]) -> list[Files]:
    out, held, size = [], [], 0
    for f in files:
        if held and size + f.size + OPEN_BYTES > TASK_BYTES:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(f.path)
        size += f.size + OPEN_BYTES
    return [*out, Files(tuple(held))] if held else out


def _read(root: str, part: Files) -> Iterator[pa.RecordBatch]:
    """Whole files, a few small ones a batch; bytes that are no UTF-8 become U+FFFD."""
    fs, _ = open_path(root)
    paths, texts, size = [], [], 0
    for i, path in enumerate(part.paths):
        with fs.open_input_stream(path) as f:
            texts.append(f.read().decode("utf-8", "replace"))
        paths.append(path)
        size += len(texts[-1])
        if size >= BATCH_BYTES or len(paths) == BATCH_FILES or i + 1 == len(part.paths):
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])
            paths, texts, size = [], [], 0


class _BatchReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Files]:
        packed = [(type(part), part.__getstate__()) for part in _dealt(self.root)]  # plain paths of one task at a time
        return [_Packed(kind is Folders, state) for kind, state in packed] or [Files(())]

    def read(self, partition: Files | _Packed) -> Iterator[pa.RecordBatch]:
        part = partition.part() if isinstance(partition, _Packed) else partition
        if isinstance(part, Folders):
            fs, _ = open_path(self.root)
            part = Files(tuple(f.path for folder in part.paths for f in _below(fs, folder)))
        return _read(self.root, part)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of change: a batch holds the files changed after its start and up to its end.

    A file must come with a time later than those already read, as it does when it is written
    and moved at once; the checkpoint keeps nothing but the last time.
    """

    def __init__(self, root: str) -> None:
        self.root = root
        self.seen: tuple[int, list[pafs.FileInfo]] | None = None  # the listing that gave the last offset, until its batch is dealt out

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        files = _listed(self.root)
        last = files[-1].mtime_ns if files else 0
        self.seen = last, files
        return {"changed": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        if start["changed"] >= end["changed"]:
            return []  # as Spark asks when a stream goes on
        files = self.seen[1] if self.seen and self.seen[0] == end["changed"] else _listed(self.root)
        self.seen = None
        return _tasks([f for f in files if start["changed"] < f.mtime_ns <= end["changed"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the checkpoint."""


class _Stager(DataSourceArrowWriter):
    """Files from rows (path, content): what stands behind the root's last folder name in ``path`` is the place below the root."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, base = open_path(self.root)
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                _put(fs, f"{base}/{path.as_py().lstrip('/')}", (content.as_py() or "").encode())
        return WriterCommitMessage()


class Submissions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "submissions"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Stager(self.options["path"])


# --- misses ----------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Log:
    """``data`` holds files of lines, ``commits`` one small file for each job that names its data files.

    Lines count only if a commit names their file.  So a task that ran twice, a job that failed and one that died half-way
    leave nothing to be read, and the commit file appears at once, by a move.
    """

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator) -> Written:
        lines = [json.dumps({"ts": r.ts, "query": r.query, "filters": dict(r.filters) if r.filters is not None else None}, ensure_ascii=False) for r in iterator]
        if not lines:
            return Written(None)
        fs, base = open_path(self.root)
        name = f"{uuid.uuid4().hex}.jsonl"
        _put(fs, f"{base}/data/{name}", ("\n".join(lines) + "\n").encode())
        return Written(name)

    def publish(self, messages: list[Written | None], job: str) -> None:
        fs, base = open_path(self.root)
        target = f"{base}/commits/{job}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.drop(messages)  # a batch that was published before the restart
            return
        _put(fs, target, "\n".join(m.name for m in messages if m and m.name).encode())

    def drop(self, messages: list[Written | None]) -> None:
        fs, base = open_path(self.root)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{base}/data/{m.name}")

    def files(self) -> list[str]:
        fs, base = open_path(self.root)
        commits = fs.get_file_info(pafs.FileSelector(f"{base}/commits", allow_not_found=True))
        return [f"{base}/data/{line}" for c in commits if c.is_file and not c.base_name.startswith(".") for line in _lines(fs, c.path)]


class _MissWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.log, self.job = _Log(root), f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list) -> None:
        self.log.publish(messages, self.job)

    def abort(self, messages: list) -> None:
        self.log.drop(messages)


class _MissStreamWriter(DataSourceStreamWriter):
    def __init__(self, root: str, stream: str) -> None:
        self.log, self.stream = _Log(root), stream

    def write(self, iterator: Iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.log.publish(messages, f"{self.stream}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.log.drop(messages)


class _MissReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.log = _Log(root)

    def partitions(self) -> list[Files]:
        return [Files((p,)) for p in self.log.files()] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = open_path(self.log.root)
        for path in partition.paths:
            for line in _lines(fs, path):
                r = json.loads(line)
                yield r["ts"], r["query"], r["filters"]


class Misses(DataSource):
    """Option ``stream`` names a stream that writes here, so that its batches are published once each."""

    @classmethod
    def name(cls) -> str:
        return "misses"

    def schema(self) -> str:
        return "ts double, query string, filters map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MissReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _MissWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _MissStreamWriter(self.options["path"], self.options.get("stream", "stream"))


def register(spark: SparkSession) -> None:
    # the workers that plan reads and commits get no shipped files, so this module travels inside the classes
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Submissions)
    spark.dataSource.register(Misses)
