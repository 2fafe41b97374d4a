"""Source that follows append-only JSON Lines files by byte offset, as a stream or, from given offsets, as a batch.

What an offset says of each file is how many bytes were taken (always up to a line end),
digests of the first and last of them, and the file's size, time and number. With the option
`states` a file of that folder holds this, a snapshot, and the offset has its name alone, so
that what passes through Spark's driver does not grow with the number of files; without it the
offset itself holds all, packed. Either is written and read as a stream in order of folder and
name, and files are listed a folder at a time, so none is held in memory as a whole.

A file that its state shows to be as it was is not opened again. Files that shrank, or whose taken bytes changed, give
one reset row and are taken up again at their end, without replaying what replaced them.
Files share tasks, of which there are as many as are asked for, however many files there are.
Driver and executors read the files by path, so these lie on a file system that all share.
"""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import io
import json
import os
import stat
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from itertools import batched, groupby
from typing import BinaryIO, NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes at either end of the taken part that its digests cover, and how far back a line end is sought at a time.
EDGE, STEP = 1 << 16, 1 << 13

#: Seconds after its last change from which a file's time tells a further one, however coarse the clock.
QUIET = 2.0

#: Tasks that a batch's files are dealt to where no number is given, the bytes that opening a file counts for, and files looked at together.
TASKS, OPEN_BYTES, TOGETHER = 64, 1 << 14, 16

#: Hexadecimal digits of a digest that an offset keeps, snapshots kept where no number is given, and bytes of a batch's list of pieces that stay in memory.
DIGITS, RETAIN, SPOOL = 32, 100, 1 << 20


def last_line_end(path: str) -> int:
    """Offset just past the last line end, found from the file's end backwards; 0 without one."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - STEP)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def digests(path: str, taken: int) -> list[str]:
    with open(path, "rb") as f:
        head = f.read(min(EDGE, taken))
        f.seek(max(0, taken - EDGE))
        tail = f.read(min(EDGE, taken))
    return [hashlib.sha256(part).hexdigest()[:DIGITS] for part in (head, tail)]


class State(NamedTuple):
    taken: int
    digests: list[str]
    mark: list[int] | None


def order(path: str) -> tuple[str, str]:
    """By this the files of an offset are sorted."""
    return os.path.split(path)


def _write(rows: Iterable, raw: BinaryIO) -> str:
    """Write rows as compressed lines, and return a digest of these."""
    digest = hashlib.sha256()
    with gzip.GzipFile("", "wb", 6, raw, 0) as f:
        for row in rows:
            line = json.dumps(row, separators=(",", ":")).encode() + b"\n"
            digest.update(line)
            f.write(line)
    return digest.hexdigest()[:DIGITS]


def _read(raw: BinaryIO) -> Iterator[list]:
    with gzip.GzipFile("", "rb", fileobj=raw) as f:
        yield from map(json.loads, f)


def offset_of(files: Iterable[tuple[str, State]], states: str | None = None) -> dict[str, str]:
    """An offset of the states of files, which come in order; a snapshot in the folder `states`, where that is given, has them."""
    rows = ((path, *own) for path, own in files)
    if not states:
        raw = io.BytesIO()
        _write(rows, raw)
        return {"files": base64.b64encode(raw.getbuffer()).decode()}
    os.makedirs(states, exist_ok=True)
    begun = os.path.join(states, f".{uuid.uuid4().hex}")
    try:
        with open(begun, "xb") as raw:
            name = _write(rows, raw)
            raw.flush()
            os.fsync(raw.fileno())
        os.replace(begun, os.path.join(states, name))
    except BaseException:
        with suppress(FileNotFoundError):
            os.unlink(begun)
        raise
    return {"snapshot": name}


def states_of(offset: dict[str, str], states: str | None = None) -> Iterator[tuple[str, State]]:
    """(path, state) of the files of an offset, in order; also of one that was written before offsets were packed, or packed as a whole."""
    if "snapshot" in offset:
        if not states:
            raise ValueError("this offset names a snapshot: the option states must name its folder")
        with open(os.path.join(states, offset["snapshot"]), "rb") as raw:
            yield from ((path, State(*own)) for path, *own in _read(raw))
        return
    text = offset["files"]
    raw = text.encode() if text.startswith("{") else base64.b64decode(text)
    if raw.startswith(b"\x1f\x8b"):
        yield from ((path, State(*own)) for path, *own in _read(io.BytesIO(raw)))
        return
    known = json.loads(raw if text.startswith("{") else zlib.decompress(raw))
    for path in sorted(known, key=order):
        own = known[path]
        yield path, State(own["taken"], [d[:DIGITS] for d in own["digests"]], own.get("mark"))


def _beside(files: Iterable[tuple], known: Iterator[tuple[str, State]]) -> Iterator[tuple]:
    """Each of files with its known state, None without one; both come in order."""
    at = next(known, None)
    for path, own in files:
        while at and order(at[0]) < order(path):
            at = next(known, None)
        yield path, own, at[1] if at and at[0] == path else None


def _together(f: Callable, items: Iterable) -> Iterator:
    """f of each item in order; files are waited for together, and looked ahead at by a few for each thread."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        for some in batched(items, 16 * TOGETHER):
            yield from pool.map(f, some)


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    reset: bool = False


@dataclass
class Pieces(InputPartition):
    """Pieces that one task reads, file by file."""

    packed: bytes

    @property
    def pieces(self) -> Iterator[Piece]:
        return (Piece(*row) for row in _read(io.BytesIO(self.packed)))


def dealt(pieces: Iterable[Piece], tasks: int) -> list[Piece | Pieces]:
    """At most `tasks` partitions, in order, of about as many bytes and files each; a piece by itself where there are few."""
    weight = lambda p: OPEN_BYTES + p.end - p.start
    n = total = before = 0
    with tempfile.SpooledTemporaryFile(SPOOL, "w+", encoding="ascii") as listed:
        for p in pieces:
            n, total = n + 1, total + weight(p)
            listed.write(json.dumps((p.path, p.start, p.end, p.reset)) + "\n")
        listed.seek(0)
        every = (Piece(*json.loads(line)) for line in listed)
        if n <= tasks:
            return list(every)

        def task(p: Piece) -> int:
            nonlocal before
            at, before = before * tasks // total, before + weight(p)
            return at

        def packed(own: Iterable[Piece]) -> Pieces:
            raw = io.BytesIO()
            _write(((p.path, p.start, p.end, p.reset) for p in own), raw)
            return Pieces(raw.getvalue())

        return [packed(own) for _, own in groupby(every, key=task)]


class JsonlTail(DataSource):
    """Options: path (a glob), startingOffsets (earliest, latest or, for a batch, the JSON of an offset), onlyPath (one file among those of path), tasks (partitions of a batch, at most), states (a folder for snapshots, of one query alone, that lasts as long as its checkpoint), retain (snapshots kept before the one committed last)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "path string, start bigint, `end` bigint, value string, reset boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)

    def reader(self, schema) -> DataSourceReader:
        return PendingReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern, self.only = options["path"], options.get("onlypath") or options.get("onlyPath")
        self.latest = (options.get("startingoffsets") or options.get("startingOffsets") or "earliest") == "latest"
        self.tasks = int(options.get("tasks") or TASKS)
        self.states, self.retain = options.get("states"), int(options.get("retain") or RETAIN)
        self.known = offset_of(())

    def __getstate__(self) -> dict:
        """What tasks get: nothing that grows with the number of files."""
        return {**self.__dict__, "known": None}

    def _files(self) -> Iterator[tuple[str, os.stat_result]]:
        folder, name = os.path.split(self.pattern)
        only = None if self.only is None else os.path.abspath(self.only)
        met = only is None
        for own in sorted(set(map(os.path.abspath, glob.glob(folder) if folder else [""]))):
            for path in sorted(glob.glob(os.path.join(glob.escape(own), name))):
                if only is None or path == only:
                    s = os.lstat(path)
                    if stat.S_ISREG(s.st_mode):
                        met = True
                        yield path, s
        if not met:
            raise ValueError(f"{self.only} is not among the files of {self.pattern}")

    def now(self, known: dict) -> Iterator[tuple[str, State]]:
        """The states of the files as they are; what the known offset says of those that stayed holds."""

        def look(found: tuple[str, os.stat_result, State | None]) -> tuple[str, State]:
            path, s, before = found
            mark = [s.st_size, s.st_mtime_ns, s.st_ino] if time.time() - s.st_mtime > QUIET else None
            if mark and before and before.mark == mark:
                return path, before
            taken = last_line_end(path)
            return path, State(taken, digests(path, taken), mark)

        return _together(look, _beside(self._files(), states_of(known, self.states)))

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.latest else offset_of(())

    def latestOffset(self) -> dict:
        self.known = offset_of(self.now(self.known), self.states)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Piece | Pieces]:
        return self.between(start, states_of(end, self.states))

    def between(self, start: dict, after: Iterable[tuple[str, State]]) -> list[Piece | Pieces]:
        def look(found: tuple[str, State, State | None]) -> Piece | None:
            path, own, known = found
            known = known or State(0, [], None)
            if own.mark and known.mark == own.mark:
                return None
            changed = known.taken > own.taken or (known.taken and known.digests != digests(path, known.taken))
            if changed:
                return Piece(path, own.taken, own.taken, True)
            return Piece(path, known.taken, own.taken) if own.taken > known.taken else None

        return dealt(filter(None, _together(look, _beside(after, states_of(start, self.states)))), self.tasks)

    def read(self, partition: Piece | Pieces):
        for piece in partition.pieces if isinstance(partition, Pieces) else [partition]:
            yield from self._read(piece)

    def _read(self, piece: Piece):
        if piece.reset:
            yield piece.path, piece.start, piece.end, None, True
            return
        with open(piece.path, "rb") as f:
            f.seek(piece.start)
            at = piece.start
            while at < piece.end:
                line = f.readline()
                if not line:  # the file has shrunk since; the next offset tells
                    break
                start, at = at, at + len(line)
                if line.strip():
                    text = line.decode("utf-8", errors="replace")
                    try:
                        json.loads(text)
                    except ValueError as e:
                        raise ValueError(f"{piece.path}, byte {start}: a complete line that is not JSON: {e}") from None
                    yield piece.path, start, at, text.rstrip("\r\n"), False

    def commit(self, end: dict) -> None:
        """Offsets are kept by the query's checkpoint; snapshots older than the `retain` before this offset's go."""
        if "snapshot" not in end:
            return
        made = {e.name: e.stat().st_mtime_ns for e in os.scandir(self.states)}
        older = [name for name in made if made[name] < made[end["snapshot"]]]
        for name in sorted(older, key=made.__getitem__, reverse=True)[self.retain :]:
            os.unlink(os.path.join(self.states, name))


class PendingReader(DataSourceReader):
    """What a stream that stands at the given offset would take up now; nothing is committed, and no snapshot written."""

    def __init__(self, options):
        self.tail = TailReader(options)
        given = options.get("startingoffsets") or options.get("startingOffsets") or "earliest"
        self.start = offset_of(()) if given == "earliest" else None if given == "latest" else json.loads(given)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "start": None}

    def partitions(self) -> list[Piece | Pieces]:
        # from the latest offset on there is nothing
        found = self.tail.between(self.start, self.tail.now(self.start)) if self.start else []
        return found or [Piece("", 0, 0)]

    def read(self, partition: Piece | Pieces):
        if isinstance(partition, Pieces) or partition.path:
            yield from self.tail.read(partition)
