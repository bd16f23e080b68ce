"""Block-compressed text: split reads without an index, region reads and index building with one.

``strandline_lines`` yields the lines of blocked gzip files. A file is cut by bytes; a task finds the first block
in its range by its magic number, and owns the lines that begin in its blocks. With an index
(``.tbi`` or ``.csi``) and a region only the chunks that may hold it are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions import cigar as cg
from strandline.functions import variants
from strandline.functions.regions import Region
from strandline.sources import bgzf, binning, storage, text

_MAGIC = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00", re.S)
TASK_BYTES = 32 << 20
BATCH = 20_000


def _files(path: str) -> list[str]:
    return storage.listed(path, (".gz", ".bgz"))


def index_of(path: str) -> binning.Index | None:
    for ending, parse in ((".tbi", binning.parse_tbi), (".csi", binning.parse_csi)):
        if storage.exists(path + ending):
            with storage.reading(path + ending) as f:
                return parse(bgzf.Reader(f).read())
    return None


class _Piece(InputPartition):
    """Bytes ``start`` .. ``end`` of a file, or a chunk of virtual positions."""

    def __init__(self, path: str, start: int, end: int, chunk: bool) -> None:
        self.path, self.start, self.end, self.chunk = path, start, end, chunk


def first_block(f, start: int) -> int | None:
    """The first block that begins at or after a byte; a chance match is told apart by decoding it."""
    f.seek(start)
    window = f.read((1 << 17) + 64)
    for m in _MAGIC.finditer(window):
        f.seek(start + m.start())
        try:
            if bgzf.read_block(f) is not None:
                return start + m.start()
        except (ValueError, zlib.error, struct.error):
            continue
    return None


def lines_of(piece: _Piece) -> Iterator[bytes]:
    with storage.reading(piece.path) as f:
        r = bgzf.Reader(f)
        if piece.chunk:
            r.seek(piece.start)
            rest = b""
            while True:
                at = r.position
                if at >= piece.end and not rest:
                    return
                block = r.read(max(1, len(r.data) - r.pos)) if at < piece.end or rest else b""
                if not block:
                    if rest:
                        yield rest
                    return
                limit = None if at >> 16 != piece.end >> 16 else (piece.end & 0xFFFF) - (at & 0xFFFF)
                own, more = (block, b"") if limit is None else (block[: max(limit, 0)], block[max(limit, 0) :])
                *whole, rest = (rest + own).split(b"\n")
                yield from whole
                if more:
                    if rest:
                        yield rest + more.split(b"\n", 1)[0]
                    return
        first = 0 if piece.start == 0 else first_block(f, piece.start)
        if first is None or first >= piece.end:
            return
        # a line belongs to the task in whose blocks it begins; that of the first byte is known from the byte before
        f.seek(first)
        rest, skip, at = b"", first > 0, first
        while (got := bgzf.read_block(f)) is not None:
            data, size = got
            if at >= piece.end:
                # only the line begun before still has to be finished
                head, cut, _ = data.partition(b"\n")
                rest += head
                if cut:
                    break
            else:
                *whole, rest = (rest + data).split(b"\n")
                if skip and whole:
                    whole, skip = whole[1:], False
                yield from whole
            at += size
        if rest and not skip:
            yield rest


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = _files(options["path"])
        self.region = Region.parse(options["region"]) if options.get("region") else None
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            index = index_of(p) if self.region else None
            if index is None or index.header is None:
                size = storage.size(p)
                out += [_Piece(p, a, min(a + self.task_bytes, size), False) for a in range(0, max(size, 1), self.task_bytes)]
            elif self.region.name in index.header.names:
                out += [_Piece(p, a, z, True) for a, z in index.query(index.header.names.index(self.region.name), self.region.start, self.region.end)]
        return out or [_Piece("", 0, 0, False)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[str] = []
        for line in lines_of(partition):
            rows.append(line.decode("utf-8", "replace").removesuffix("\r"))
            if len(rows) == BATCH:
                yield self._batch(rows, partition.path)
                rows = []
        if rows:
            yield self._batch(rows, partition.path)

    @staticmethod
    def _batch(rows: list[str], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array([path] * len(rows))], ["value", "file"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_lines"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_lines(spark: SparkSession, path: str, *, region: str | None = None) -> DataFrame:
    """Lines ``value`` of blocked gzip files with their ``file``; with a region a superset of its lines."""
    spark.dataSource.register(LinesSource)
    reader = spark.read.format("strandline_lines").option("path", path)
    return (reader.option("region", region) if region else reader).load()


def read_region(spark: SparkSession, path: str, preset: str, region: str) -> DataFrame:
    """Records of a region of an indexed ``vcf``, ``bed``, ``gff``, ``gtf`` or ``sam`` file: exactly those that overlap it."""
    lines, r = read_lines(spark, path, region=region), Region.parse(region)
    c = F.col
    if preset == "vcf":
        df = text.vcf_columns(lines, keep=["file"])
        return df.where(r.overlaps(c("chrom"), c("pos"), variants.variant_end(c("pos"), c("ref"), end=F.try_element_at(c("info"), F.lit("END")).try_cast("bigint"))))
    if preset == "bed":
        return text.bed_columns(lines, width=3, keep=["file"]).where(r.overlaps(c("chrom"), c("start"), c("end")))
    if preset in ("gff", "gtf"):
        return text.feature_columns(lines, kind=preset, keep=["file"]).where(r.overlaps(c("seqid"), c("start"), c("end")))
    if preset == "sam":
        return text.sam_columns(lines, keep=["file"]).where(r.overlaps(c("rname"), c("pos"), cg.alignment_end(c("pos"), c("cigar"))))
    raise ValueError(f"unknown preset {preset!r}")


def read_indexed_fields(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Lines of any tab-separated file that overlap a region, by the fields that its index names: ``fields`` and ``file``."""
    r = Region.parse(region)
    found = [index.header for p in _files(path) if (index := index_of(p)) is not None and index.header is not None]
    if len({(h.format, h.sequence, h.start, h.end, h.comment) for h in found}) != 1:
        raise ValueError("the files need indexes with the same fields")
    h = found[0]
    f = F.split("value", "\t")
    start = F.get(f, F.lit(h.start - 1)).try_cast("bigint") + (1 if h.format & 0x10000 else 0)
    end = F.coalesce(F.get(f, F.lit(h.end - 1)).try_cast("bigint"), start) if h.end else start
    lines = read_lines(spark, path, region=region).where(~F.col("value").startswith(h.comment))
    return lines.where(r.overlaps(F.get(f, F.lit(h.sequence - 1)), start, end)).select(f.alias("fields"), "file")


def _interval(fields: list[str], preset: str) -> tuple[str, int, int]:
    code, seq, start, end, _ = binning.PRESETS[preset]
    a = int(fields[start - 1]) + (1 if code & 0x10000 else 0)
    if preset == "vcf":
        m = re.search(r"(?:^|;)END=(\d+)", fields[7]) if len(fields) > 7 else None
        z = int(m[1]) if m else a + len(fields[3]) - 1
    elif preset == "sam":
        z = a + max(sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", fields[5]) if op in "MDN=X"), 1) - 1
    else:
        z = int(fields[end - 1])
    return fields[seq - 1], a, max(z, a)


def write_index(path: str, preset: str, *, csi: bool = False) -> str:
    """Index a sorted blocked text file beside it; records without a position raise. ``gtf`` has the fields of ``gff``."""
    preset = "gff" if preset == "gtf" else preset
    names: dict[str, int] = {}
    found: list[tuple[int, int, int, tuple[int, int]]] = []
    comment = binning.PRESETS[preset][4]
    unplaced = 0
    with storage.reading(path) as f:
        r = bgzf.Reader(f)
        rest, begun = b"", r.position
        for line, chunk in _positioned(r):
            if not line or line.startswith(comment):
                continue
            fields = line.split("\t")
            if preset == "sam" and fields[2] == "*":
                unplaced += 1
                continue
            name, a, z = _interval(fields, preset)
            if a < 1:
                raise ValueError("a record without a position can't be indexed")
            found.append((names.setdefault(name, len(names)), a, z, chunk))
    b = binning.Builder(len(names), csi=csi)
    for ref, a, z, chunk in found:
        b.add(ref, a, z, True, chunk)
    index = b.finish()
    index.unplaced, index.header = unplaced, binning.preset(preset, list(names))
    out = path + (".csi" if csi else ".tbi")
    with storage.writing(out) as f:
        w = bgzf.Writer(f)
        w.write(binning.csi_bytes(index) if csi else binning.tbi_bytes(index))
        w.close()
    return out


def _positioned(r: bgzf.Reader) -> Iterator[tuple[str, tuple[int, int]]]:
    """Lines with the virtual positions of their begin and of the byte after their line feed."""
    begun, held = r.position, b""
    while True:
        if r.pos >= len(r.data) and not r._advance():
            if held:
                yield held.decode("utf-8", "replace"), (begun, r.position)
            return
        cut = r.data.find(b"\n", r.pos)
        if cut < 0:
            held += r.data[r.pos :]
            r.pos = len(r.data)
            continue
        line = held + r.data[r.pos : cut]
        r.pos, held = cut + 1, b""
        yield line.decode("utf-8", "replace").removesuffix("\r"), (begun, r.position)
        begun = r.position


class _Writer(storage.PartsWriter):
    """Lines as block-compressed files, each beginning with the header."""

    ending = ".gz"

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.ending = options.get("ending", ".gz")
        super().__init__(options, overwrite)

    def encode(self, batches: Iterator[pa.RecordBatch], out: BinaryIO) -> None:
        w = bgzf.Writer(out)
        w.write(self.options.get("header", "").encode())
        for b in batches:
            w.write(b"".join(line.encode() + b"\n" for line in b.column(0).to_pylist()))
        w.close()


def write_lines(df: DataFrame, line: Column, path: str, *, ending: str = ".gz", header: str = "", mode: str = "append") -> None:
    """Lines as block-compressed files (``ending`` such as ``.sam.gz``), one per partition, each beginning with ``header`` (with its line feeds)."""
    df.sparkSession.dataSource.register(LinesSource)
    df.select(line.alias("value"), F.lit("").alias("file")).write.format("strandline_lines").option("ending", ending).option("header", header).mode(mode).save(path)


def reheader(path: str, header: str, out: str, comment: str = "#") -> None:
    """The records of a blocked text file under another header (with its line feeds); whole lines after the old header are copied."""
    with storage.reading(path) as f, storage.writing(out) as g:
        r, w = bgzf.Reader(f), bgzf.Writer(g)
        w.write(header.encode())
        rest, heading = b"", True
        while piece := r.read(1 << 20):
            if not heading:
                w.write(piece)
                continue
            rest += piece
            while heading and (cut := rest.find(b"\n")) >= 0:
                if rest.startswith(comment.encode()):
                    rest = rest[cut + 1 :]
                else:
                    heading = False
            if not heading:
                w.write(rest)
                rest = b""
        if rest and not rest.startswith(comment.encode()):
            w.write(rest)
        w.close()


def compress(lines: Iterator[str], path: str) -> None:
    """Lines as one blocked gzip file."""
    with storage.writing(path) as f:
        w = bgzf.Writer(f)
        for line in lines:
            w.write(line.encode() + b"\n")
        w.close()
