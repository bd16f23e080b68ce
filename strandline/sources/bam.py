"""Binary alignments: record codec, a Python data source with index-planned partitions, and index building.

``spark.read.format("strandline_bam")`` yields the rows that ``read_sam`` yields. A file is cut into tasks by bytes: a
task looks for the first block in its range and in it for the first record, told by a chain of
plausible records, and owns the records that begin in its blocks. With an index beside the file a region
reads only the chunks that may hold it. ``read_bam`` adds the exact overlap test as a column expression.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions import bins as B
from strandline.functions import cigar as cg
from strandline.functions.bases import FOUR_BIT
from strandline.functions.regions import Region
from strandline.functions.tags import TAG_STRUCT
from strandline.sources import bgzf, binning, storage
from strandline.sources.headers import SamHeader

SCHEMA = f"name string, flags int, rname string, pos bigint, mapq smallint, cigar string, mate_rname string, mate_pos bigint, tlen int, seq string, qual string, tags map<string,{TAG_STRUCT}>"
_VALUE = pa.struct([("type", pa.string()), ("i", pa.int64()), ("f", pa.float32()), ("s", pa.string()), ("ai", pa.list_(pa.int64())), ("af", pa.list_(pa.float32()))])
ARROW = pa.schema(
    [("name", pa.string()), ("flags", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int16()), ("cigar", pa.string()), ("mate_rname", pa.string()), ("mate_pos", pa.int64()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), _VALUE))]
)
_FIXED = struct.Struct("<iiBBHHHIiii")
_OPS = "MIDNSHP=X"
#: Sizes and formats of the binary tag types.
_TAG = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_PAIRS = [a + b for a in FOUR_BIT for b in FOUR_BIT]
_CODE = {c: i for i, c in enumerate(FOUR_BIT)} | {c.lower(): i for i, c in enumerate(FOUR_BIT)}
BATCH = 10_000


def _value(ty: str, i=None, f=None, s=None, ai=None, af=None) -> dict:
    return {"type": ty, "i": i, "f": f, "s": s, "ai": ai, "af": af}


def decode_tags(raw: bytes, at: int) -> list[tuple[str, dict]]:
    out = []
    while at < len(raw):
        tag, ty = raw[at : at + 2].decode("ascii"), chr(raw[at + 2])
        at += 3
        if ty == "A":
            out.append((tag, _value("A", s=chr(raw[at]))))
            at += 1
        elif ty in "ZH":
            end = raw.index(0, at)
            out.append((tag, _value(ty, s=raw[at:end].decode("utf-8", "replace"))))
            at = end + 1
        elif ty == "B":
            sub = chr(raw[at])
            (n,) = struct.unpack_from("<I", raw, at + 1)
            items = list(struct.unpack_from(f"<{n}{_TAG[sub]}", raw, at + 5))
            out.append((tag, _value("B" + sub, af=items) if sub == "f" else _value("B" + sub, ai=items)))
            at += 5 + n * struct.calcsize(_TAG[sub])
        elif ty in _TAG:
            (v,) = struct.unpack_from("<" + _TAG[ty], raw, at)
            out.append((tag, _value("f", f=v) if ty == "f" else _value("i", i=v)))
            at += struct.calcsize(_TAG[ty])
        else:
            raise ValueError(f"invalid tag type {ty!r}")
    return out


def decode(raw: bytes, names: list[str]) -> tuple:
    """One record (without its size) as a row."""
    ref, pos, n_name, mapq, _, n_ops, flags, n_seq, mate, mate_pos, tlen = _FIXED.unpack_from(raw)
    at = 32
    name = raw[at : at + n_name - 1].decode("utf-8", "replace")
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (n_seq + 1) // 2]
    at += len(packed)
    seq = "".join([_PAIRS[b] for b in packed])[:n_seq]
    qual = raw[at : at + n_seq]
    at += n_seq
    tags = decode_tags(raw, at)
    if n_ops == 2 and ops[0] & 15 == 4 and ops[1] & 15 == 3 and ops[0] >> 4 == n_seq:
        # too many operations for the record: they are in a tag
        held = next((v for t, v in tags if t == "CG" and v["type"] == "BI"), None)
        if held:
            ops, tags = held["ai"], [x for x in tags if x[0] != "CG"]
    cigar = "".join([f"{o >> 4}{_OPS[o & 15]}" for o in ops])
    return (
        None if name == "*" else name, flags, names[ref] if ref >= 0 else None, pos + 1 if pos >= 0 else None, None if mapq == 255 else mapq, cigar or None,
        names[mate] if mate >= 0 else None, mate_pos + 1 if mate_pos >= 0 else None, tlen, seq or None, None if not qual or qual[0] == 255 else qual.translate(_UP).decode("ascii", "replace"), tags,
    )


_UP = bytes((i + 33) & 127 for i in range(256))


def _encode_int(v: int) -> bytes:
    for ty, lo, hi in (("c", -128, 127), ("C", 0, 255), ("s", -(2**15), 2**15 - 1), ("S", 0, 2**16 - 1), ("i", -(2**31), 2**31 - 1), ("I", 0, 2**32 - 1)):
        if lo <= v <= hi:
            return ty.encode() + struct.pack("<" + _TAG[ty], v)
    raise ValueError(f"tag value out of range: {v}")


def encode_tags(tags: dict[str, dict] | list[tuple[str, dict]] | None) -> bytes:
    out = []
    for tag, v in (tags.items() if isinstance(tags, dict) else tags or []):
        ty, get = v["type"], lambda k, v=v: v[k]
        if ty == "i":
            body = _encode_int(get("i"))
        elif ty == "f":
            body = b"f" + struct.pack("<f", get("f"))
        elif ty in "AZH":
            body = ty.encode() + get("s").encode() + (b"" if ty == "A" else b"\0")
        else:
            items = get("af") if ty[1] == "f" else get("ai")
            body = b"B" + ty[1].encode() + struct.pack(f"<I{len(items)}{_TAG[ty[1]]}", len(items), *items)
        out.append(tag.encode() + body)
    return b"".join(out)


def _operations(cigar: str | None) -> list[int]:
    out, n = [], 0
    for c in cigar or "":
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            out.append(n << 4 | _OPS.index(c))
            n = 0
    return out


def _span(ops: list[int]) -> int:
    return sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8))


def encode(row: tuple, ids: dict[str, int]) -> bytes:
    """A row as a record with its size. Raises for names, sequences and scores that the format can't hold."""
    name, flags, rname, pos, mapq, cigar, mate_rname, mate_pos, tlen, seq, qual, tags = row
    raw_name = (name or "*").encode()
    if len(raw_name) > 254:
        raise ValueError("the name is too long")
    seq = seq or ""
    if qual is not None and seq and len(qual) != len(seq):
        raise ValueError("sequence and scores differ in length")
    ops = _operations(cigar)
    tag_bytes = encode_tags(tags)
    span = _span(ops)
    if len(ops) > 65535:
        tag_bytes += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    for n in (rname, mate_rname):
        if n is not None and n not in ids:
            raise ValueError(f"{n!r} is not in the dictionary")
    codes = [_CODE.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    scores = bytes(ord(c) - 33 for c in qual) if qual and seq else b"\xff" * len(seq)
    bin_ = B.plain_reg2bin(pos, pos + max(span, 1) - 1) & 0xFFFF if pos else B.UNMAPPED_BIN
    fixed = _FIXED.pack(ids.get(rname, -1), (pos or 0) - 1, len(raw_name) + 1, 255 if mapq is None else mapq, bin_, len(ops), flags, len(seq), ids.get(mate_rname, -1), (mate_pos or 0) - 1, tlen or 0)
    body = fixed + raw_name + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + tag_bytes
    return struct.pack("<i", len(body)) + body


def read_header(r: bgzf.Reader) -> tuple[SamHeader, list[str]]:
    """Header and dictionary names; the binary dictionary counts where the text has none, else both must agree."""
    if r.read(4) != b"BAM\1":
        raise ValueError("no binary alignments")
    (n,) = struct.unpack("<i", r.read(4))
    header = SamHeader.parse(r.read(n).rstrip(b"\0").decode("utf-8"))
    (n,) = struct.unpack("<i", r.read(4))
    held: dict[str, str] = {}
    for _ in range(n):
        (size,) = struct.unpack("<i", r.read(4))
        name = r.read(size)[:-1].decode()
        held[name] = str(struct.unpack("<i", r.read(4))[0])
    if not header.sequences:
        header.sequences = {k: {"SN": k, "LN": v} for k, v in held.items()}
    elif {k: f["LN"] for k, f in header.sequences.items()} != held or list(header.sequences) != list(held):
        raise ValueError("the dictionaries of text and binary header differ")
    return header, list(held)


def header_bytes(header: SamHeader) -> bytes:
    text = str(header).encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(header.sequences))]
    for k, f in header.sequences.items():
        out.append(struct.pack("<i", len(k.encode()) + 1) + k.encode() + b"\0" + struct.pack("<i", int(f["LN"])))
    return b"".join(out)


def records(r: bgzf.Reader, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Virtual positions and bytes of the records up to the position ``end``."""
    while end is None or r.position < end:
        at = r.position
        size = r.read(4)
        if not size:
            return
        (n,) = struct.unpack("<i", size)
        raw = r.read(n)
        if len(raw) < n:
            raise ValueError("truncated record")
        yield at, raw


def index_of(path: str) -> binning.Index | None:
    """The index beside a file: ``.bai``, then ``.csi``."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        if storage.exists(name):
            with storage.reading(name) as f:
                return binning.parse_bai(f.read())
    if storage.exists(f"{path}.csi"):
        with storage.reading(f"{path}.csi") as f:
            return binning.parse_csi(bgzf.Reader(f).read())
    return None


def build_index(f: BinaryIO, *, csi: bool = False) -> binning.Index:
    """The index of a coordinate-sorted file; anything else raises."""
    r = bgzf.Reader(f)
    header, names = read_header(r)
    if not header.is_coordinate_sorted:
        raise ValueError("only files sorted by coordinate can be indexed")
    b = binning.Builder(len(names), csi=csi)
    for at, raw in records(r):
        ref, pos, n_name, _, _, n_ops, flags, *_ = _FIXED.unpack_from(raw)
        ops = struct.unpack_from(f"<{n_ops}I", raw, 32 + n_name)
        start = pos + 1 if pos >= 0 else None
        b.add(ref if ref >= 0 else None, start, start and start + max(_span(list(ops)), 1) - 1, not flags & 4, (at, r.position))
    return b.finish()


def write_index(path: str, *, csi: bool = False) -> str:
    with storage.reading(path) as f:
        index = build_index(f, csi=csi)
    out = f"{path}.csi" if csi else f"{path}.bai"
    with storage.writing(out) as f:
        if csi:
            w = bgzf.Writer(f)
            w.write(binning.csi_bytes(index))
            w.close()
        else:
            f.write(binning.bai_bytes(index))
    return out


def quickcheck(path: str) -> bool:
    """Whether a file has a dictionary and ends as it should."""
    with storage.reading(path) as f:
        try:
            header, _ = read_header(bgzf.Reader(f))
        except (ValueError, struct.error, UnicodeDecodeError):
            return False
        return bool(header.sequences) and bgzf.has_eof(f)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _plausible(data: bytes, at: int, references: int) -> int | None:
    """Where the record at ``at`` would end, if what stands there can be one; the rest of ``data`` may be too short to tell."""
    if at + 36 > len(data):
        return at
    size, ref, pos, n_name, _, _, n_ops, flags, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHIiii", data, at)
    if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and n_name >= 1 and flags < 4096):
        return None
    if not 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq <= size < 1 << 28:
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def _first_record(f: BinaryIO, start: int, end: int, references: int, *, chain: int = 8) -> int | None:
    """Virtual position of the first record that begins in a block at or after the byte ``start`` and before ``end``."""
    from strandline.sources.blocked_text import first_block

    block = first_block(f, start)
    while block is not None and block < end:
        f.seek(block)
        r = bgzf.Reader(f)
        data = r.read(1)
        own, following = len(r.data), r.next
        data += r.read(1 << 18)
        for at in range(own):
            to, seen = at, 0
            while to is not None and seen < chain and to + 36 <= len(data):
                to, seen = _plausible(data, to, references), seen + 1
            if to is not None and (seen or len(data) - at >= 36):
                return block << 16 | at
        block = following if own else None
    return None


class _Piece(InputPartition):
    """A chunk of virtual positions, or (``cut``) the records of the blocks within bytes."""

    def __init__(self, path: str, start: int | None, end: int | None, cut: bool = False) -> None:
        self.path, self.start, self.end, self.cut = path, start, end, cut


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = _files(options["path"])
        self.region = Region.parse(options["region"]) if options.get("region") else None
        self.task_bytes = int(options.get("task_bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with storage.reading(p) as f:
                if isinstance(bgzf.opened(f), bgzf.Plain):
                    out.append(_Piece(p, None, None))  # nothing marks a place to begin at
                    continue
            index = index_of(p) if self.region is not None else None
            if index is None:
                size = storage.size(p)
                out += [_Piece(p, a, min(a + self.task_bytes, size), cut=True) for a in range(0, max(size, 1), self.task_bytes)]
                continue
            with storage.reading(p) as f:
                _, names = read_header(bgzf.Reader(f))
            if self.region.name not in names:
                raise ValueError(f"{self.region.name!r} is not in the dictionary of {p}")
            out += [_Piece(p, a, z) for a, z in index.query(names.index(self.region.name), self.region.start, self.region.end)]
        return out or [_Piece("", None, None)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with storage.reading(partition.path) as f:
            r = bgzf.opened(f)
            _, names = read_header(r)
            end = partition.end
            if isinstance(r, bgzf.Plain):
                pass
            elif not partition.cut:
                r.seek(partition.start)
            else:
                end = partition.end << 16
                if partition.start > 0:
                    first = _first_record(f, max(partition.start, 1), partition.end, len(names))
                    if first is None:
                        return
                    r.seek(max(first, self._after_header(partition.path)))
            rows: list[tuple] = []
            for _, raw in records(r, end):
                rows.append(decode(raw, names))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    @staticmethod
    def _after_header(path: str) -> int:
        """The first record's position: a large header may fill more than a task's bytes."""
        with storage.reading(path) as f:
            r = bgzf.Reader(f)
            read_header(r)
            return r.position


def _files(path: str) -> list[str]:
    return storage.listed(path, (".bam",))


class _Writer(storage.PartsWriter):
    ending = ".bam"

    def encode(self, batches: Iterator[pa.RecordBatch], out: BinaryIO) -> None:
        header = SamHeader.parse(self.options.get("header", ""))
        ids = {n: i for i, n in enumerate(header.sequences)}
        w = bgzf.Writer(out)
        w.write(header_bytes(header))
        for b in batches:
            for row in b.to_pylist():
                w.write(encode(tuple(row.values()), ids))
        w.close()


class BamSource(DataSource):
    """``spark.read.format("strandline_bam")`` and ``df.write.format("strandline_bam")`` (option ``header``: its text)."""

    @classmethod
    def name(cls) -> str:
        return "strandline_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam(spark: SparkSession, path: str, *, region: str | None = None) -> DataFrame:
    """Alignments of a file, a folder or a pattern, of a region if given (exactly those that overlap it)."""
    register(spark)
    reader = spark.read.format("strandline_bam").option("path", path)
    if region is None:
        return reader.load()
    r = Region.parse(region)
    return reader.option("region", region).load().where(r.overlaps(F.col("rname"), F.col("pos"), cg.alignment_end(F.col("pos"), F.col("cigar"))))


def write_bam(df: DataFrame, path: str, header: SamHeader, *, mode: str = "append") -> None:
    """One file per partition in the folder ``path``."""
    register(df.sparkSession)
    df.select(*[f.name for f in ARROW]).write.format("strandline_bam").option("header", str(header)).mode(mode).save(path)


def concatenate(paths: list[str], out: str) -> None:
    """Records of several files under the header of the first, copied as they are."""
    with storage.writing(out) as g:
        w = bgzf.Writer(g)
        for i, p in enumerate(paths):
            with storage.reading(p) as f:
                r = bgzf.Reader(f)
                header, _ = read_header(r)
                if i == 0:
                    w.write(header_bytes(header))
                while piece := r.read(1 << 20):
                    w.write(piece)
        w.close()


def reheader(path: str, header: SamHeader, out: str) -> None:
    """The records of a file under another header."""
    with storage.reading(path) as f, storage.writing(out) as g:
        r, w = bgzf.Reader(f), bgzf.Writer(g)
        read_header(r)
        w.write(header_bytes(header))
        while piece := r.read(1 << 20):
            w.write(piece)
        w.close()
