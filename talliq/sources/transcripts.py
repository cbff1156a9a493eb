"""Append-only NDJSON transcripts as a data source, in batches or as a stream, from byte cursors.

    spark.dataSource.register(TranscriptSource)
    spark.read.format("transcripts").load("/folder")          # whole files, in ranges of bytes
    spark.readStream.format("transcripts").load("/folder")    # what was appended, as it comes

Spark's own file stream never looks at a file again and gives out half-written lines, so this source keeps a cursor for
each file: byte offset, inode, and a hash of the first line. A cursor holds while inode and hash are the same and the
file isn't shorter; otherwise the file is read from its start. Lines without their end yet are left for later. A line
beyond maxLineBytes is skipped and reported. Options: path (a folder, or one file), maxLineBytes, maxLinesPerBatch (for
each file), cursors (JSON by path, from which reading goes on), rangeBytes. A task reads as many ranges as it takes to be
worth its start. With maxBatches, a batch read takes so many times maxLinesPerBatch, and has a column step: which of them
a line is in, from 0.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schemas

MAX_LINE, HEAD, RANGE = 4 << 20, 4096, 128 << 20
#: Lines and bytes of an Arrow batch.
BATCH, BATCH_BYTES = 4096, 8 << 20
#: Files that are looked at side by side when a scan is planned.
LOOKERS = 16
#: Bytes in which line ends are counted.
BLOCK = 4 << 20
#: Small ranges share tasks: tasks of such a scan, bytes of one at least and at most, and bytes that opening a file is worth.
TASKS, TASK_LEAST, TASK_MOST, OPENING = 64, 1 << 20, 32 << 20, 1 << 14


@dataclass(frozen=True)
class Cursor:
    """Where reading a file stopped. head_hash 0: the first line wasn't known yet."""

    byte_offset: int = 0
    file_id: int = 0
    head_hash: int = 0


def discover(root: str) -> list[str]:
    """All files below a folder whose extension is jsonl, sorted. Links are not followed, unreadable folders skipped."""
    if os.path.isfile(root):
        return [root]
    found = []
    for folder, _, names in os.walk(root, onerror=lambda e: None, followlinks=False):
        for name in names:
            path = os.path.join(folder, name)
            stem, dot, extension = name.rpartition(".")
            if dot and stem and extension == "jsonl" and not os.path.islink(path) and os.path.isfile(path):
                found.append(path)
    return sorted(found)


def head_hash(path: str) -> int:
    """A hash of the first line, never 0; 0 while the first line has no end within the first 4096 bytes."""
    with open(path, "rb") as f:
        head = f.read(HEAD)
    end = head.find(b"\n")
    return int.from_bytes(hashlib.blake2b(head[: end + 1], digest_size=7).digest(), "big") | 1 if end >= 0 else 0


def identity(path: str) -> tuple[int, int, int]:
    """Length, inode and hash of the first line."""
    stat = os.stat(path)
    return stat.st_size, stat.st_ino, head_hash(path)


def resumed(path: str, cursor: Cursor | None) -> tuple[Cursor, bool]:
    """Where to go on, and whether a file that was replaced is read anew."""
    length, inode, head = identity(path)
    if cursor is None:
        return Cursor(0, inode, head), False
    same = cursor.file_id == inode and cursor.byte_offset <= length and cursor.head_hash in (0, head)
    return Cursor(cursor.byte_offset if same else 0, inode, head), not same


def lines(path: str, start: int, stop: int | None = None, most: int | None = None, longest: int = MAX_LINE) -> Iterator[tuple[int, int, bytes | None]]:
    """Whole lines that start in [start, stop): where they start and end, and their bytes, None if too long."""
    with open(path, "rb") as f:
        f.seek(start)
        at, count = start, 0
        while (stop is None or at < stop) and (most is None or count < most):
            line = f.readline(longest)
            if not line:
                return
            if not line.endswith(b"\n"):
                if len(line) < longest:
                    return
                size = len(line)
                while True:
                    rest = f.readline(longest)
                    if not rest:
                        return
                    size += len(rest)
                    if rest.endswith(b"\n"):
                        break
                yield at, at + size, None
                at += size
            else:
                yield at, at + len(line), line[:-1]
                at += len(line)
            count += 1


def whole_end(path: str, start: int, most: int | None, longest: int) -> int:
    """Behind the last whole line from start, or behind the last of so many."""
    if most is not None:
        return ([start] + ends(path, start, most, 1))[-1]
    with open(path, "rb") as f:
        at = f.seek(0, 2)
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return at - step + k + 1
            at -= step
    return start


def ends(path: str, start: int, most: int, batches: int) -> list[int]:
    """Where each of so many batches of at most so many whole lines ends; line ends are only counted."""
    import numpy as np

    out, count, last = [], 0, start
    with open(path, "rb") as f:
        at = f.seek(start)
        while len(out) < batches and (block := f.read(min(BLOCK, most * batches * OPENING))):
            found = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
            full = found[most - 1 - count :: most][: batches - len(out)]
            out += (full + (at + 1)).tolist()
            if len(found):
                last = at + int(found[-1]) + 1
            count = (count + len(found)) % most
            at += len(block)
    if len(out) < batches and last > (out[-1] if out else start):
        out.append(last)
    return out


@dataclass
class FileRange:
    path: str
    start: int
    stop: int
    file_id: int
    head_hash: int
    aligned: bool
    step: int = 0


@dataclass
class Task(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[FileRange] = field(default_factory=list)


def _tasks(ranges: list[FileRange]) -> list[Task]:
    """Deals ranges to tasks in their order. What is larger than a task's share stays alone."""
    share = min(max(sum(r.stop - r.start + OPENING for r in ranges) // TASKS, TASK_LEAST), TASK_MOST)
    out, weight = [Task()], 0
    for r in ranges:
        size = r.stop - r.start + OPENING
        if out[-1].ranges and weight + size > share:
            out.append(Task())
            weight = 0
        out[-1].ranges.append(r)
        weight += size
    return out


class _Options:
    def __init__(self, options):
        self.root = options.get("path", ".")
        self.longest = int(options.get("maxLineBytes", MAX_LINE))
        self.most = int(options["maxLinesPerBatch"]) if options.get("maxLinesPerBatch") else None
        self.batches = int(options["maxBatches"]) if options.get("maxBatches") else None
        self.range = int(options.get("rangeBytes", RANGE))
        self.cursors = {p: Cursor(**c) for p, c in json.loads(options.get("cursors") or "{}").items()}


def _read(task: Task, longest: int, steps: bool = False):
    """Batches of the lines of a task's ranges. A file that can't be read any more ends its range: its cursor stays where
    lines were read, and the other files go on."""
    held: list[tuple[FileRange, tuple[int, int, bytes | None]]] = []
    size = 0
    for part in task.ranges:
        try:
            for row in _lines(part, longest):
                held.append((part, row))
                size += len(row[2] or b"")
                if len(held) == BATCH or size >= BATCH_BYTES:
                    yield _batch(held, steps)
                    held, size = [], 0
        except OSError:
            continue
    if held:
        yield _batch(held, steps)


def _lines(part: FileRange, longest: int) -> Iterator[tuple[int, int, bytes | None]]:
    start = part.start
    if not part.aligned:  # the line that reaches into this range belongs to the range before
        with open(part.path, "rb") as f:
            f.seek(start - 1)
            while (chunk := f.readline(1 << 20)) and not chunk.endswith(b"\n"):
                pass
            start = f.tell()
    return lines(part.path, start, part.stop, None, longest)


def _batch(held: list[tuple[FileRange, tuple[int, int, bytes | None]]], steps: bool):
    """Lines as an Arrow batch, which costs far less than a row each."""
    import pyarrow as pa

    rows = [row for _, row in held]
    columns = {
        "path": pa.array([p.path for p, _ in held], pa.string()), "offset": pa.array([r[0] for r in rows], pa.int64()), "end": pa.array([r[1] for r in rows], pa.int64()),
        "line": pa.array([None if r[2] is None else r[2].decode("utf-8", "replace") for r in rows], pa.string()), "too_long": pa.array([r[2] is None for r in rows], pa.bool_()),
        "file_id": pa.array([p.file_id for p, _ in held], pa.int64()), "head_hash": pa.array([p.head_hash for p, _ in held], pa.int64()),
    }
    if steps:
        columns["step"] = pa.array([p.step for p, _ in held], pa.int64())
    return pa.record_batch(columns)


def _ranges(path: str, start: int, stop: int, inode: int, head: int, size: int, step: int = 0) -> list[FileRange]:
    return [FileRange(path, a, min(a + size, stop), inode, head, a == start, step) for a in range(start, stop, size)]


def positions(options: _Options, cursors: dict[str, Cursor]) -> list[tuple[str, Cursor, list[int]]]:
    """For each file, where reading goes on and behind which whole lines its batches end; at least one end. Files are
    looked at side by side, as that is mostly waiting; one that can't be read doesn't hold up the others."""

    def position(path: str) -> tuple[str, Cursor, list[int]] | None:
        try:
            cursor, _ = resumed(path, cursors.get(path))
            if options.most is not None and options.batches is not None:
                return path, cursor, ends(path, cursor.byte_offset, options.most, options.batches) or [cursor.byte_offset]
            return path, cursor, [whole_end(path, cursor.byte_offset, options.most, options.longest)]
        except OSError:
            return None

    with ThreadPoolExecutor(LOOKERS) as pool:
        return [p for p in pool.map(position, discover(options.root)) if p is not None]


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self):
        out = []
        for path, cursor, stops in positions(self.options, self.options.cursors):
            for step, (start, stop) in enumerate(zip([cursor.byte_offset, *stops], stops, strict=False)):
                out += _ranges(path, start, stop, cursor.file_id, cursor.head_hash, self.options.range, step)
        return _tasks(out)

    def read(self, partition):
        return _read(partition, self.options.longest, self.options.batches is not None)


class StreamReader(DataSourceStreamReader):
    """Offsets are JSON: for each path the cursor behind what was taken."""

    def __init__(self, options):
        self.options = _Options(options)
        self.options.batches = None  # a trigger's lines are one batch
        self.taken = dict(self.options.cursors)

    def initialOffset(self) -> dict:
        return {"files": {p: asdict(c) for p, c in self.options.cursors.items()}}

    def latestOffset(self) -> dict:
        for path, cursor, stops in positions(self.options, self.taken):
            self.taken[path] = Cursor(stops[-1], cursor.file_id, cursor.head_hash)
        return {"files": {p: asdict(c) for p, c in sorted(self.taken.items())}}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, to in end["files"].items():
            self.taken[path] = to = Cursor(**to)
            known = start["files"].get(path)
            at = Cursor(**known) if known else Cursor()
            same = at.file_id == to.file_id and at.byte_offset <= to.byte_offset and at.head_hash in (0, to.head_hash)
            out += _ranges(path, at.byte_offset if same else 0, to.byte_offset, to.file_id, to.head_hash, self.options.range)
        return _tasks(out)

    def read(self, partition):
        return _read(partition, self.options.longest)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the offsets."""


class TranscriptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return schemas.RAW + (", step BIGINT" if self.options.get("maxBatches") else "")

    def reader(self, schema):
        return BatchReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def default_root() -> str:
    """Where the assistant keeps its transcripts."""
    return os.path.join(os.path.expanduser("~"), ".claude", "projects")
