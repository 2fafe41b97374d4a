"""Batch source of the lines of append-only logs, cut by byte ranges, so that one large file is read by many tasks.

A piece is a range of bytes and holds the lines that start in it. Pieces are cut by a fixed
size, not by how many tasks there are, so a line has the same piece and place whoever reads
it; they share tasks, whose number follows the bytes and the cores, not the pieces. Line numbers come from the counts of lines of a file's earlier pieces, which are taken
only where a file has more than one. Paths are those that driver and executors both open;
other file systems are reached through pyarrow.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a piece, and of a read; small files share a partition up to the former.
PIECE_BYTES, READ_BYTES = 64 << 20, 4 << 20

#: Bytes that a read beyond a piece takes at least, those of a task at least, and those that a piece counts for beside its own.
TAIL_BYTES, TASK_BYTES, OPEN_BYTES = 1 << 16, 1 << 20, 1 << 10

#: Rows of an Arrow batch.
ROWS = 4096

SCHEMA = "path string, piece int, at bigint, value string"


def _system(root: str):
    """(pyarrow file system, path on it) of a path with a scheme of its own; (None, path) of one that open() takes."""
    scheme, colon, rest = root.partition("://")
    if not colon:
        return None, root.removeprefix("file:")
    if scheme == "file":
        return None, "/" + rest.lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def safe_files(root: str, *patterns: str) -> list[str]:
    """Sorted regular files under root that match a pattern; symbolic links, and files reached through one, are left out."""
    top, plain = Path(root).resolve(), {}
    found = {p for pattern in patterns for p in Path(root).glob(pattern)}

    def own(folder: Path) -> bool:
        """Whether no link leads to folder, which is looked at once."""
        if folder not in plain:
            plain[folder] = folder.resolve() == top / folder.relative_to(root)
        return plain[folder]

    return sorted(str(p) for p in found if stat.S_ISREG(p.lstat().st_mode) and own(p.parent))


def listed(root: str, pattern: str, after: float | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of the files under root that match pattern, sorted; those that were not changed after a time are left out."""
    system, base = _system(root)
    if system is None:
        stats = [(p, os.stat(p)) for p in safe_files(base, pattern)]
        return [(p, s.st_size) for p, s in stats if after is None or s.st_mtime > after]
    from pyarrow import fs

    every = system.get_file_info(fs.FileSelector(base, recursive=True))
    inside = [i for i in every if i.type == fs.FileType.File and Path(i.path).relative_to(base).match(pattern) and i.path.count("/") - base.rstrip("/").count("/") == pattern.count("/") + 1]
    return sorted((i.path, i.size) for i in inside if after is None or i.mtime.timestamp() > after)


@dataclass
class Pieces(InputPartition):
    """(path, number of the piece, first byte, byte after the last) of each piece."""

    pieces: list[tuple[str, int, int, int]]


class LogLines(DataSource):
    """Options: root, pattern (relative, * and ** as in globs), modifiedAfter (ISO, UTC), pieceBytes, pieces, tasks (over which pieces are dealt; without it a task has pieceBytes).

    pieces: `all`; `first` or `later` pieces of files only; `counts`, of files with several
    pieces each piece's number of lines, in `at`.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LineReader({k.lower(): v for k, v in self.options.items()})


class _LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["root"], options.get("pattern", "*/*.jsonl")
        self.bytes, self.pieces = int(options.get("piecebytes", PIECE_BYTES)), options.get("pieces", "all")
        self.tasks = int(options.get("tasks", 0))
        since = options.get("modifiedafter")
        self.after = datetime.fromisoformat(since).replace(tzinfo=timezone.utc).timestamp() if since else None

    def partitions(self) -> list[Pieces]:
        every = list(self._cut())
        share = self.bytes
        if self.tasks:
            whole = sum(end - start + OPEN_BYTES for *_, start, end in every)
            share = min(PIECE_BYTES, max(TASK_BYTES, -(-whole // self.tasks)))
        out, together, held = [], [], 0
        for path, piece, start, end in every:
            more = end - start + (OPEN_BYTES if self.tasks else 0)
            if together and held + more > share:
                out.append(Pieces(together))
                together, held = [], 0
            together.append((path, piece, start, end))
            held += more
        return [*out, Pieces(together)]

    def _cut(self) -> Iterator[tuple[str, int, int, int]]:
        for path, size in listed(self.root, self.pattern, self.after):
            if self.pieces == "counts" and size <= self.bytes:
                continue
            for piece, start in enumerate(range(0, size, self.bytes)):
                if piece and self.pieces == "first":
                    break
                if not piece and self.pieces == "later":
                    continue
                yield path, piece, start, min(size, start + self.bytes)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.root)
        ready: list[tuple] = []
        for path, own in groupby(partition.pieces, key=itemgetter(0)):
            with open(path, "rb") if system is None else system.open_input_file(path) as f:
                for _, piece, start, end in own:
                    if self.pieces == "counts":
                        ready.append((path, piece, starts_in(f, start, end), None))
                        continue
                    for at, line in enumerate(lines_from(f, start, end)):
                        ready.append((path, piece, at, line.decode("utf-8", "replace")))
                        if len(ready) == ROWS:
                            yield _batch(ready)
                            ready = []
        if ready:
            yield _batch(ready)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, piece, at, value = zip(*rows, strict=True)
    arrays = [pa.array(path, pa.string()), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(value, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "piece", "at", "value"])


def starts_in(f, start: int, end: int) -> int:
    """How many lines start in a range of bytes: those after a line end before each byte, and the file's first."""
    n, left = int(start == 0 < end), end - 1 - max(0, start - 1)
    f.seek(max(0, start - 1))
    while left > 0:
        block = f.read(min(READ_BYTES, left))
        if not block:
            break
        n, left = n + block.count(b"\n"), left - len(block)
    return n


def lines_from(f, start: int, end: int) -> Iterator[bytes]:
    """The lines that start in a range of bytes, without their ends; the last may reach beyond it."""
    at = max(0, start - 1)
    f.seek(at)
    skipping, parts = start > 0, []
    while True:
        block = f.read(min(READ_BYTES, max(end - at, TAIL_BYTES)))
        if not block:
            break
        begin = 0
        while (stop := block.find(b"\n", begin)) >= 0:
            if not skipping:
                parts.append(block[begin:stop])
                yield b"".join(parts)
                parts = []
            skipping, begin = False, stop + 1
            if at + begin >= end:
                return
        if not skipping:
            parts.append(block[begin:])
        at += len(block)
    if parts and any(parts):
        yield b"".join(parts)


def lines(spark: SparkSession, root: str, pattern: str = "*/*.jsonl", modified_after: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, line_no, value): every line of the files, numbered from 1."""
    spark.dataSource.register(LogLines)
    options = {"root": root, "pattern": pattern, "pieceBytes": str(piece_bytes), "tasks": str(4 * spark.sparkContext.defaultParallelism)} | ({"modifiedAfter": modified_after} if modified_after else {})
    read = lambda pieces: spark.read.format("log_lines").options(**options, pieces=pieces).load()
    upto = F.sum("at").over(Window.partitionBy("path").orderBy("piece")) - F.col("at")  # a row for each piece of a large file
    before = read("counts").select("path", "piece", upto.alias("_before")).filter("piece > 0")
    first = read("first").select("path", (F.col("at") + 1).alias("line_no"), "value")
    later = read("later").join(before, ["path", "piece"]).select("path", (F.col("_before") + F.col("at") + 1).alias("line_no"), "value")
    return first.unionByName(later)
