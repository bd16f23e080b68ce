"""Binary variants: typed-value codec, records, and a Python data source with the rows of ``read_vcf``."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions.regions import Region
from strandline.functions.variants import variant_end
from strandline.sources import bgzf, binning, storage
from strandline.sources.headers import VcfHeader

SCHEMA = "chrom string, pos bigint, ids array<string>, ref string, alt array<string>, qual float, filters array<string>, info map<string,string>, format array<string>, samples array<map<string,string>>"
_LIST, _MAP = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
ARROW = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("ids", _LIST), ("ref", pa.string()), ("alt", _LIST), ("qual", pa.float32()), ("filters", _LIST), ("info", _MAP), ("format", _LIST), ("samples", pa.list_(_MAP))])
#: Type codes with their formats, missing and end-of-vector values.
_INT = {1: ("b", 1, -128, -127), 2: ("h", 2, -(2**15), -(2**15) + 1), 3: ("i", 4, -(2**31), -(2**31) + 1)}
_FLOAT_MISSING, _FLOAT_END = 0x7F800001, 0x7F800002
BATCH = 5_000


class _Cursor:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from("<" + fmt, self.raw, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out

    def kind(self) -> tuple[int, int]:
        """Type code and length of a typed value."""
        (b,) = self.take("B")
        n = b >> 4
        return b & 15, self.values(*self.kind())[0] if n == 15 else n

    def values(self, ty: int, n: int) -> list:
        """``n`` values: numbers (None where missing, cut at the end of the vector) or one string."""
        if ty == 0 or n == 0:
            return []
        if ty == 7:
            raw = self.raw[self.at : self.at + n]
            self.at += n
            return [raw.rstrip(b"\0").decode("utf-8", "replace")]
        if ty == 5:
            bits = self.take(f"{n}I")
            out = []
            for b in bits:
                if b == _FLOAT_END:
                    break
                out.append(None if b == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", b))[0])
            return out
        fmt, _, missing, end = _INT[ty]
        out = []
        for v in self.take(f"{n}{fmt}"):
            if v == end:
                break
            out.append(None if v == missing else v)
        return out

    def typed(self) -> list:
        return self.values(*self.kind())


def _number(v) -> str:
    if v is None:
        return "."
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return {True: "nan"}.get(math.isnan(v), "inf" if v > 0 else "-inf")
        short = f"{v:.7g}"
        return short if "e" not in short else repr(v)
    return str(v)


def _texts(values: list) -> str | None:
    if not values:
        return None
    return ",".join(_number(v) if not isinstance(v, str) else v for v in values)


def genotype_text(values: list[int | None], version: tuple[int, int]) -> str:
    """``(allele + 1) << 1 | phased`` per allele; before 4.4 the first mark is not written."""
    out = []
    for i, v in enumerate(values):
        allele = "." if v is None or v >> 1 == 0 else str((v >> 1) - 1)
        mark = "|" if v is not None and v & 1 else "/"
        out.append(allele if i == 0 and (version < (4, 4) or mark == "/") else mark + allele)
    return "".join(out)


def decode(site: bytes, calls: bytes, header: VcfHeader, contigs: list[str], strings: dict[int, str]) -> tuple:
    c = _Cursor(site)
    chrom, pos, _, = c.take("iii")
    (bits,) = c.take("I")
    qual = None if bits == _FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", bits))[0]
    n_info, n_allele, samples_format = c.take("HHI")
    n_sample, n_format = samples_format & 0xFFFFFF, samples_format >> 24
    ids = c.typed()
    alleles = [(c.typed() or [""])[0] for _ in range(n_allele)]
    filters = [strings[i] for i in c.typed()]
    info = []
    for _ in range(n_info):
        key = strings[c.typed()[0]]
        flag = header.type_of("INFO", key)[1] == "Flag"
        ty, n = c.kind()
        values = c.values(ty, n)
        info.append((key, None if flag else _texts(values) or "."))
    c = _Cursor(calls)
    keys, columns = [], []
    for _ in range(n_format):
        key = strings[c.typed()[0]]
        ty, n = c.kind()
        keys.append(key)
        column = []
        for _ in range(n_sample):
            values = c.values(ty, n) if ty else []
            column.append(genotype_text(values, header.version) if key == "GT" and ty != 7 else _texts(values))
        columns.append(column)
    samples = [[(k, None if col[i] in (None, ".") else col[i]) for k, col in zip(keys, columns)] for i in range(n_sample)] if keys else None
    return contigs[chrom], pos + 1 if pos >= 0 else None, ids[0].split(";") if ids and ids[0] not in ("", ".") else [], alleles[0], alleles[1:], qual, filters, info, keys or None, samples


def _head(ty: int, n: int) -> bytes:
    return bytes([n << 4 | ty]) if n < 15 else bytes([0xF0 | ty]) + typed_ints([n])


def typed_ints(values: list[int | None], pad: int | None = None) -> bytes:
    """Integers in the narrowest type that holds them all."""
    n = pad or len(values)
    known = [v for v in values if v is not None]
    for ty, (fmt, size, missing, end) in _INT.items():
        top = 2 ** (8 * size - 1) - 1
        if all(missing + 8 <= v <= top for v in known):
            body = [missing if v is None else v for v in values] + [end] * (n - len(values))
            return _head(ty, n) + struct.pack(f"<{n}{fmt}", *body)
    raise ValueError("integer out of range")


def typed_floats(values: list[float | None], pad: int | None = None) -> bytes:
    n = pad or len(values)
    body = b"".join(struct.pack("<I", _FLOAT_MISSING) if v is None else struct.pack("<f", v) for v in values)
    return _head(5, n) + body + struct.pack("<I", _FLOAT_END) * (n - len(values))


def typed_text(text: str, pad: int | None = None) -> bytes:
    raw = text.encode()
    n = pad or len(raw)
    return _head(7, n) + raw + b"\0" * (n - len(raw))


def _split(text: str | None, of) -> list:
    return [] if text is None else [None if v == "." else of(v) for v in text.split(",")]


def _calls(text: str | None) -> list[int | None]:
    import re

    out = []
    for mark, allele in re.findall(r"([/|]?)(\d+|\.)", text or ""):
        out.append((0 if allele == "." else int(allele) + 1) << 1 | (mark == "|"))
    return out


def encode(row: tuple, header: VcfHeader) -> bytes:
    chrom, pos, ids, ref, alt, qual, filters, info, format_, samples = row
    number, contigs = header.string_map(), list(header.records["contig"])
    info = dict(info or {})
    end = info.get("END")
    span = int(end) - (pos or 0) + 1 if end and end.isdigit() else len(ref)
    out = [struct.pack("<iii", contigs.index(chrom), (pos or 0) - 1, span), struct.pack("<I", _FLOAT_MISSING) if qual is None else struct.pack("<f", qual)]
    out.append(struct.pack("<HHI", len(info), 1 + len(alt or []), len(samples or []) | len(format_ or []) << 24))
    out.append(typed_text(";".join(ids)) if ids else _head(7, 0))
    out += [typed_text(a) for a in (ref, *(alt or []))]
    out.append(typed_ints([number[f] for f in filters]) if filters else b"\x00")
    for k, v in info.items():
        ty = header.type_of("INFO", k)[1]
        body = b"\x00" if ty == "Flag" or v is None else typed_ints(_split(v, int)) if ty == "Integer" else typed_floats(_split(v, float)) if ty == "Float" else typed_text(v)
        out.append(typed_ints([number[k]]) + body)
    calls = []
    for k in format_ or []:
        ty = header.type_of("FORMAT", k)[1]
        texts = [dict(s or {}).get(k) for s in samples]
        if k == "GT" or ty == "Integer":
            lists = [_calls(t) if k == "GT" else _split(t, int) for t in texts]
            widest = max([len(x) for x in lists] + [1])
            known = [v for x in lists for v in x if v is not None]
            code, (fmt, size, missing, endv) = next((c, t) for c, t in _INT.items() if all(t[2] + 8 <= v <= 2 ** (8 * t[1] - 1) - 1 for v in known))
            body = b"".join(struct.pack(f"<{widest}{fmt}", *[missing if v is None else v for v in (x or [None])], *[endv] * (widest - max(len(x), 1))) for x in lists)
            body = _head(code, widest) + body
        elif ty == "Float":
            lists = [_split(t, float) or [None] for t in texts]
            widest = max(len(x) for x in lists)
            body = _head(5, widest) + b"".join(typed_floats(x, widest)[len(_head(5, widest)) :] for x in lists)
        else:
            raws = [(t or ".").encode() for t in texts]
            widest = max(len(r) for r in raws)
            body = _head(7, widest) + b"".join(r + b"\0" * (widest - len(r)) for r in raws)
        calls.append(typed_ints([number[k]]) + body)
    site, rest = b"".join(out), b"".join(calls)
    return struct.pack("<II", len(site), len(rest)) + site + rest


def read_header(r: bgzf.Reader) -> VcfHeader:
    magic = r.read(5)
    if magic[:3] != b"BCF" or magic[3] != 2:
        raise ValueError("no binary variants")
    (n,) = struct.unpack("<I", r.read(4))
    return VcfHeader.parse(r.read(n).rstrip(b"\0").decode())


def write_to(f: BinaryIO, rows: Iterator[tuple], header: VcfHeader) -> None:
    text = str(header).encode() + b"\0"
    w = bgzf.Writer(f)
    w.write(b"BCF\2\2" + struct.pack("<I", len(text)) + text)
    for row in rows:
        w.write(encode(row, header))
    w.close()


def _files(path: str) -> list[str]:
    return storage.listed(path, (".bcf",))


def records(r: bgzf.Reader, end: int | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """Virtual positions, sites and calls of the records up to the position ``end``."""
    while end is None or r.position < end:
        at = r.position
        sizes = r.read(8)
        if len(sizes) < 8:
            return
        a, b = struct.unpack("<II", sizes)
        yield at, r.read(a), r.read(b)


def write_index(path: str) -> str:
    """A CSI index beside a sorted file; a record without a position raises."""
    with storage.reading(path) as f:
        r = bgzf.Reader(f)
        header = read_header(r)
        b = binning.Builder(len(header.records["contig"]), csi=True)
        for at, site, _ in records(r):
            chrom, pos, span = struct.unpack_from("<iii", site)
            if pos < 0:
                raise ValueError("a record without a position can't be indexed")
            b.add(chrom, pos + 1, pos + max(span, 1), True, (at, r.position))
    with storage.writing(f"{path}.csi") as f:
        w = bgzf.Writer(f)
        w.write(binning.csi_bytes(b.finish()))
        w.close()
    return f"{path}.csi"


class _Piece(InputPartition):
    """A whole file, or a chunk of virtual positions."""

    def __init__(self, path: str, start: int | None = None, end: int | None = None) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = _files(options["path"])
        self.region = Region.parse(options["region"]) if options.get("region") else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            if self.region is None or not storage.exists(f"{p}.csi"):
                out.append(_Piece(p))
                continue
            with storage.reading(p) as f, storage.reading(f"{p}.csi") as g:
                contigs = list(read_header(bgzf.Reader(f)).records["contig"])
                index = binning.parse_csi(bgzf.Reader(g).read())
            if self.region.name in contigs:
                out += [_Piece(p, a, z) for a, z in index.query(contigs.index(self.region.name), self.region.start, self.region.end)]
        return out or [_Piece("")]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with storage.reading(partition.path) as f:
            r = bgzf.opened(f)
            header = read_header(r)
            contigs, strings = list(header.records["contig"]), {i: k for k, i in header.string_map().items()}
            if partition.start is not None:
                r.seek(partition.start)
            rows: list[tuple] = []
            for _, site, calls in records(r, partition.end):
                rows.append(decode(site, calls, header, contigs, strings))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class _Writer(storage.PartsWriter):
    ending = ".bcf"

    def encode(self, batches: Iterator[pa.RecordBatch], out: BinaryIO) -> None:
        rows = (tuple(r[f.name] for f in ARROW) for b in batches for r in b.to_pylist())
        write_to(out, rows, VcfHeader.parse(self.options["header"]))


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_bcf(spark: SparkSession, path: str, *, region: str | None = None) -> DataFrame:
    """Variants of files with the columns of ``read_vcf``: one task a file, or of a region (exactly those that overlap it) one a chunk."""
    spark.dataSource.register(BcfSource)
    reader = spark.read.format("strandline_bcf").option("path", path)
    if region is None:
        return reader.load()
    end = F.try_element_at(F.col("info"), F.lit("END")).try_cast("bigint")
    df = reader.option("region", region).load()
    return df.where(Region.parse(region).overlaps(F.col("chrom"), F.col("pos"), variant_end(F.col("pos"), F.col("ref"), end=end)))


def write_bcf(df: DataFrame, path: str, header: VcfHeader, *, mode: str = "append") -> None:
    """One file per partition in the folder ``path``, named when all are complete."""
    df.sparkSession.dataSource.register(BcfSource)
    df.select(*[f.name for f in ARROW]).write.format("strandline_bcf").option("header", str(header)).mode(mode).save(path)
