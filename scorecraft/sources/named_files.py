"""A data source that writes files of given names, with a commit step.

Spark's own writers name their files; artifacts that people and other programs
look for by name (``<model>__<case>.csv``) need this one. Rows ``file, content``
(a name and bytes) are written by tasks into a folder of the attempt; when all
tasks have ended, the commit checks that no name came from two tasks and moves
the files of the successful attempts to their names. A failed or lost attempt's
files are never moved, and a failed job leaves nothing under the names.

Files go through Arrow's file systems (local or mounted paths, HDFS, S3, GCS).
A file's rows must be in one task, in order: :func:`write_named_files` deals and
sorts them. A file is written by one task, as its name says it is one file.

There may be millions of files: a task lists its own in a file beside them, and
the driver gets one line a task. The commit goes through these lists a piece at
a time; :func:`read_whole_files` lists and reads large folders in tasks.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"
FILE_ROWS = "file string, content binary"
#: Moves at once in a commit, and files that each goes through before the next are dealt.
MOVERS, MOVES = 16, 16
#: A task's list of its files, beside them: a JSON array of name and number a line, by name.
LIST = "list"
#: Bytes of a list read at once; names looked up at once.
PIECE, NAMES = 1 << 14, 1000
#: Entries of a folder from which on it is listed by tasks, not by the driver.
LARGE_FOLDER = 10_000
#: Files and bytes of a batch of whole files, at which it is handed on.
BATCH_FILES, BATCH_BYTES = 1000, 1 << 23
#: What Spark's ``_metadata.file_name`` has escaped: what no path of a URI holds.
ESCAPED = re.compile(r"""[\x00- "#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]""")


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _listed(fs: arrow_fs.FileSystem, attempt: str) -> Iterator[list]:
    """``[name, number]`` of a task's files, by name. The list is not held open:
    a commit goes through those of all tasks at once."""
    at, rest = 0, b""
    while True:
        with fs.open_input_file(f"{attempt}/{LIST}") as f:
            f.seek(at)
            piece = f.read(PIECE)
        if not piece:
            return
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        yield from map(json.loads, lines)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, where they lie until the commit."""

    attempt: str


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, staging = opened(self.staging)
        attempt = f"{staging}/{uuid.uuid4().hex}"
        fs.create_dir(attempt, recursive=True)
        name, out, files, by_name = None, None, 0, True
        with fs.open_output_stream(f"{attempt}/{LIST}", compression=None, buffer_size=PIECE) as listed:
            for row in iterator:
                if row.file != name:
                    if not row.file or "/" in row.file:
                        raise ValueError(f"not a file name: {row.file!r}")
                    if out:
                        out.close()
                    by_name = by_name and (name is None or name < row.file)
                    name = row.file
                    listed.write(_line(name, files))
                    out = fs.open_output_stream(f"{attempt}/{files}", compression=None, buffer_size=PIECE)
                    files += 1
                out.write(bytes(row.content))
            if out:
                out.close()
        if not by_name:  # rows that write_named_files did not sort
            lines = b"".join(_line(*file) for file in sorted(_listed(fs, attempt)))
            with fs.open_output_stream(f"{attempt}/{LIST}", compression=None) as listed:
                listed.write(lines)
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        attempts = [m.attempt for m in messages if m is not None]
        fs, folder = opened(self.path)
        try:
            self._check(fs, folder, attempts)
            moves = ((f"{a}/{number}", f"{folder}/{name}") for a in attempts for name, number in _listed(fs, a))
            with ThreadPoolExecutor(MOVERS) as pool:
                for some in batched(batched(moves, MOVES), 4 * MOVERS):
                    list(pool.map(lambda pairs: [fs.move(*pair) for pair in pairs], some))
        finally:
            self.abort(messages)

    def _check(self, fs: arrow_fs.FileSystem, folder: str, attempts: list[str]) -> None:
        """A name has one file and, unless it may be replaced, none from before."""
        last, twice, there, first = None, [], 0, ""
        for files in batched(heapq.merge(*[_listed(fs, a) for a in attempts]), NAMES):
            for name, _ in files:
                if name == last and name not in twice and len(twice) < 3:
                    twice.append(name)
                last = name
            if not self.overwrite:
                found = fs.get_file_info([f"{folder}/{name}" for name, _ in files])
                old = [i.path for i in found if i.type != arrow_fs.FileType.NotFound]
                first = first or "".join(old[:1])
                there += len(old)
        if twice:
            raise ValueError(f"rows of one file were not together: {twice}")
        if there:
            raise FileExistsError(f"{there} files are there already: {first}")

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what was not moved."""
        fs, staging = opened(self.staging)
        if fs.get_file_info(staging).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(staging)


def _line(name: str, number: int) -> bytes:
    return json.dumps([name, number]).encode() + b"\n"


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(folder)``; mode
    ``overwrite`` replaces files of the same names and leaves others."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILE_ROWS

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named_files(rows: DataFrame, path: str, order: list[Column | str], overwrite: bool = True) -> None:
    """Write ``rows`` (``file``, ``content``) as files below ``path``, each
    file's rows in ``order``; other files there are left as they are."""
    rows.sparkSession.dataSource.register(NamedFiles)
    numbered = rows.select("file", "content", *[F.col(c) if isinstance(c, str) else c for c in order])
    keys = numbered.columns[2:]
    dealt = numbered.repartition("file").sortWithinPartitions("file", *keys).select("file", "content")
    dealt.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def _large_folder(spark: SparkSession, path: str) -> str | None:
    """The local or mounted path of a folder that tasks list: of many entries, and
    without folders that name partitions. The entries are counted, not kept."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return None
    local = hadoop_path.toUri().getPath()
    if not os.path.isdir(local):
        return None
    entries = 0
    with os.scandir(local) as found:
        for entry in found:
            if "=" in entry.name and entry.is_dir():
                return None
            entries += 1
    return os.path.abspath(local) if entries >= LARGE_FOLDER else None


def _lister(glob: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folders -> the paths of their files, of the names that Spark's readers take."""

    def wanted(entry: os.DirEntry) -> bool:
        hidden = entry.name.startswith(".") or entry.name.startswith("_") and "=" not in entry.name
        return not hidden and fnmatchcase(entry.name, glob) and entry.is_file()

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            with os.scandir(folder) as entries:
                for some in batched((e.path for e in entries if wanted(e)), BATCH_FILES):
                    yield pa.RecordBatch.from_pydict({"path": list(some)})

    return names


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths -> ``file, content``, in batches of bounded size."""
    rows, size = [], 0
    for path in (p for batch in batches for p in batch.column(0).to_pylist()):
        with open(path, "rb") as f:
            content = f.read()
        if content:  # Spark's readers give no row for an empty file
            rows.append((ESCAPED.sub(lambda c: quote(c[0]), os.path.basename(path)), content))
            size += len(content)
        if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["file", "content"])


def read_whole_files(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    """``file, value``: the name (``_metadata.file_name``) and whole text of every
    file of ``paths`` whose name matches ``glob`` (of ``*`` only).

    Spark's reader holds all entries of a folder in the driver, those that
    do not match too. So a local or mounted folder of ``LARGE_FOLDER`` entries or
    more is listed by a task, name by name, and its files are dealt over tasks;
    other folders, files and patterns are read by Spark's reader."""
    large = {path: folder for path in paths if (folder := _large_folder(spark, path))}
    found = None
    if large:
        # an RDD's size is unknown to the planner, so that it doesn't broadcast what is read from these few rows
        folders = spark.createDataFrame(spark.sparkContext.parallelize([(large[p],) for p in paths if p in large], len(large)), "folder string")
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        listed = folders.mapInArrow(_lister(glob), "path string").repartition(tasks, "path")
        found = listed.mapInArrow(_whole_files, FILE_ROWS).select("file", F.col("content").cast("string").alias("value"))
    if len(large) < len(set(paths)) or not paths:
        raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text([p for p in paths if p not in large])
        small = raw.select(F.col("_metadata.file_name").alias("file"), "value")
        found = found.unionByName(small) if found is not None else small
    return found
