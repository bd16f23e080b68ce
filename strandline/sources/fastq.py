"""Four-line reads: plain files cut by bytes, compressed ones whole."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.sources import storage

BATCH = 20_000
TASK_BYTES = 64 << 20
SCHEMA = "name string, description string, sequence string, quality string, file string"
_NAMES = ["name", "description", "sequence", "quality", "file"]


class _Piece(InputPartition):
    """Bytes ``start`` .. ``end`` of a plain file, or (no ``end``) a whole compressed one."""

    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


def _is_read(lines: list[bytes]) -> bool:
    return len(lines) == 4 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].rstrip(b"\r\n")) == len(lines[3].rstrip(b"\r\n"))


def _first(f: BinaryIO, start: int) -> int | None:
    """The byte at which the first record at or after ``start`` begins; None if there is none.

    A line of scores may look like a definition, but what follows it then is no plus line two lines later, or no second record after it.
    """
    at = start
    f.seek(max(start - 1, 0))
    if start > 0:
        at = start - 1 + len(f.readline())  # the line begun before belongs to the task before
    lines = [f.readline() for _ in range(8)]
    while lines[0]:
        if _is_read(lines[:4]) and (not lines[4].strip() or _is_read(lines[4:]) or not all(lines)):
            return at
        at += len(lines[0])
        lines = [*lines[1:], f.readline()]
    return None


def _quads(f: BinaryIO, at: int, end: int | None) -> Iterator[list[bytes]]:
    while end is None or at < end:
        quad = [f.readline() for _ in range(4)]
        if not quad[0]:
            return
        if not quad[0].strip() and not any(x.strip() for x in quad):
            return
        at += sum(map(len, quad))
        yield [x for x in quad if x]


def batches(piece: _Piece, *, strict: bool = True) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the reads that begin in a piece."""
    with storage.reading(piece.path) as raw:
        f: BinaryIO = raw if piece.end is not None else gzip.GzipFile(fileobj=raw)
        at = 0
        if piece.start:
            found = _first(f, piece.start)
            if found is None or found >= piece.end:
                return
            at = found
            f.seek(at)
        rows: list[tuple] = []
        for quad in _quads(f, at, piece.end):
            text = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in quad]
            if not _is_read(quad):
                if strict:
                    raise ValueError(f"malformed read in {piece.path}: {text[0]!r}")
                continue
            name, *rest = text[0][1:].split(None, 1)
            rows.append((name, rest[0] if rest else None, text[1], text[3], piece.path))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], _NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], _NAMES)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for at in options["paths"].split("\n") for p in storage.listed(at)]
        self.strict = options.get("strict", "True") == "True"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with storage.reading(p) as f:
                packed = f.read(2) == b"\x1f\x8b"
            if packed:
                out.append(_Piece(p, 0, None))
                continue
            size = storage.size(p)
            out += [_Piece(p, a, min(a + self.task_bytes, size)) for a in range(0, size, self.task_bytes)]
        return out or [_Piece("", 0, 0)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        return batches(partition, strict=self.strict) if partition.path else iter(())


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
