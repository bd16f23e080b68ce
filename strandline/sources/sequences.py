"""Indexed sequences: FAI files of FASTA and FASTQ, CRAI files, and region fetches without reading whole files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.regions import Region
from strandline.sources import storage


@dataclass(frozen=True)
class FaiRecord:
    name: str
    length: int
    position: int
    line_bases: int
    line_width: int

    def offset(self, start: int) -> int:
        """Byte of the 1-based base ``start``."""
        at = start - 1
        return self.position + at // self.line_bases * self.line_width + at % self.line_bases


class SequenceIndexError(ValueError):
    """A sequence that can't be indexed."""


def index_fasta(path: str) -> list[FaiRecord]:
    """Index records of a FASTA file; lines before the last must be equally long and no sequence empty."""
    out: list[FaiRecord] = []
    with storage.reading(path) as f:
        name, at = None, 0
        length = position = bases = width = 0
        ended = False

        def finish() -> None:
            if name is not None:
                if length == 0:
                    raise SequenceIndexError(f"{name} is empty")
                out.append(FaiRecord(name, length, position, bases, width))

        for line in f:
            if line.startswith(b">"):
                finish()
                name = line[1:].split(None, 1)[0].decode() if line[1:].strip() else ""
                length = bases = width = 0
                position, ended = at + len(line), False
            elif line.rstrip(b"\r\n"):
                n = len(line.rstrip(b"\r\n"))
                if bases == 0:
                    bases, width = n, len(line)
                elif ended or n > bases:
                    raise SequenceIndexError(f"uneven line bases in {name}")
                elif len(line) - n != width - bases and n == bases and line.endswith(b"\n"):
                    raise SequenceIndexError(f"uneven line width in {name}")
                ended = n < bases
                length += n
            else:
                ended = True
            at += len(line)
        finish()
    return out


def index_fastq(path: str) -> list[tuple[str, int, int, int, int, int]]:
    """Index records of a FASTQ file: name, length, offset of the bases, line bases, line width, offset of the scores."""
    out = []
    with storage.reading(path) as f:
        at = 0
        while head := f.readline():
            seq, plus, qual = f.readline(), f.readline(), f.readline()
            n = len(seq.rstrip(b"\r\n"))
            if not head.startswith(b"@") or not plus.startswith(b"+") or len(qual.rstrip(b"\r\n")) != n:
                raise SequenceIndexError("malformed read")
            first = at + len(head)
            out.append((head[1:].split(None, 1)[0].decode(), n, first, n, len(seq), first + len(seq) + len(plus)))
            at = first + len(seq) + len(plus) + len(qual)
    return out


def fai_text(records: Sequence[FaiRecord]) -> str:
    return "".join(f"{r.name}\t{r.length}\t{r.position}\t{r.line_bases}\t{r.line_width}\n" for r in records)


def parse_fai(text: str) -> list[FaiRecord]:
    return [FaiRecord(f[0], *map(int, f[1:5])) for f in (x.split("\t") for x in text.splitlines() if x)]


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, position bigint, line_bases bigint, line_width bigint")


def read_crai(spark: SparkSession, path: str) -> DataFrame:
    """Index of containers (gzip text): reference id (NULL for -1), start and span (NULL for 0), offset, landmark, slice length."""
    raw = spark.read.csv(path, sep="\t", schema="ref_id int, start bigint, span bigint, offset bigint, landmark bigint, slice_length bigint")
    return raw.withColumns({"ref_id": F.when(F.col("ref_id") >= 0, F.col("ref_id")), "start": F.when(F.col("start") > 0, F.col("start")), "span": F.when(F.col("span") > 0, F.col("span"))})


def fetch(path: str, record: FaiRecord, start: int | None = None, end: int | None = None) -> str:
    """Bases of a region read by position; an end beyond the sequence is clipped."""
    lo, hi = start or 1, min(end or record.length, record.length)
    if hi < lo:
        return ""
    a, z = record.offset(lo), record.offset(hi)
    with storage.reading(path) as f:
        f.seek(a)
        return f.read(z - a + 1).replace(b"\n", b"").replace(b"\r", b"").decode("ascii")


def fetch_regions(spark: SparkSession, path: str, index: Sequence[FaiRecord], regions: DataFrame) -> DataFrame:
    """Bases of many regions (``region`` texts): ``region`` and ``sequence``; an unknown name raises. The index is broadcast: one row per sequence."""
    held = spark.sparkContext.broadcast({r.name: r for r in index})

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            found = []
            for t in texts:
                r = Region.parse(t)
                if r.name not in held.value:
                    raise ValueError(f"{r.name!r} is not in the index")
                found.append(fetch(path, held.value[r.name], r.start, r.end))
            yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(found)], ["region", "sequence"])

    return regions.select("region").mapInArrow(get, "region string, sequence string")
