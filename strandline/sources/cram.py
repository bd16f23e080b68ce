"""Reference-compressed alignments (CRAM 3.0 and 3.1): containers, slices and records as the rows of ``read_sam``.

``spark.read.format("strandline_cram")`` reads one task per group of containers; their headers hold reference,
start and span, so a region skips containers without decoding them. Bases come from the slice's embedded
reference, from bases in the records, or from an indexed FASTA file (option ``reference``), whose checksum is verified.
"""

from __future__ import annotations

import gzip
import hashlib
import importlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions import cigar as cg
from strandline.functions.regions import Region
from strandline.sources import bam, entropy, sequences, storage
from strandline.sources.entropy import Bytes, itf8, ltf8
from strandline.sources.headers import SamHeader

#: The container that ends a file, and kinds of block content.
EOF = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
HEADER, COMPRESSION, SLICE, EXTERNAL, CORE = 0, 1, 2, 4, 5
SLICE_RECORDS = 10_240
#: Bits of the record flags, and of the flags of a detached mate.
HAS_SCORES, DETACHED, DOWNSTREAM, NO_BASES = 1, 2, 4, 8
MATE_REVERSE, MATE_UNMAPPED = 1, 2


# reading ------------------------------------------------------------------------------------


@dataclass
class Container:
    """Header of a container; ``offset`` and ``size`` are of its body."""

    offset: int
    size: int
    ref: int
    start: int
    span: int
    records: int
    blocks: int
    landmarks: list[int]

    @property
    def is_end(self) -> bool:
        return self.ref == -1 and self.start == 4542278 and self.records == 0


def _container(f) -> Container | None:
    at = f.tell()
    head = f.read(512)
    if len(head) < 4:
        return None
    while True:
        try:
            b = Bytes(head)
            (size,) = b.unpack("i")
            ref, start, span, n = b.itf8(), b.itf8(), b.itf8(), b.itf8()
            b.ltf8(), b.ltf8()
            blocks = b.itf8()
            landmarks = [b.itf8() for _ in range(b.itf8())]
            end = b.at
            (crc,) = b.unpack("I")
            break
        except (IndexError, ValueError):
            more = f.read(4096)
            if not more:
                raise ValueError("truncated container") from None
            head += more
    if zlib.crc32(head[:end]) != crc:
        raise ValueError("container checksum mismatch")
    f.seek(at + b.at)
    return Container(at + b.at, size, ref, start, span, n, blocks, landmarks)


@dataclass
class Block:
    kind: int
    id: int
    data: bytes


def _block(b: Bytes) -> Block:
    at = b.at
    method, kind = b.u8(), b.u8()
    id_, packed, size = b.itf8(), b.itf8(), b.itf8()
    data = b.take(packed)
    end = b.at
    (crc,) = b.unpack("I")
    if zlib.crc32(b.raw[at:end]) != crc:
        raise ValueError("block checksum mismatch")
    return Block(kind, id_, entropy.decompress(method, data, size))


def _open(f) -> SamHeader:
    magic = f.read(26)
    if magic[:4] != b"CRAM" or magic[4] != 3:
        raise ValueError("no CRAM 3 file")
    c = _container(f)
    raw = f.read(c.size)
    block = _block(Bytes(raw))
    (n,) = struct.unpack_from("<i", block.data)
    f.seek(c.offset + c.size)
    return SamHeader.parse(block.data[4 : 4 + n].rstrip(b"\0").decode())


def containers(f) -> Iterator[Container]:
    """Headers of the data containers, bodies skipped."""
    while (c := _container(f)) is not None:
        if c.is_end:
            return
        yield c
        f.seek(c.offset + c.size)


def containers_at(f, offsets: list[int]) -> Iterator[Container]:
    """Headers of the data containers that begin at the given bytes."""
    for at in offsets:
        f.seek(at)
        if (c := _container(f)) is not None and not c.is_end:
            yield c


class Bits:
    """Bits of the core block, the highest first."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.raw[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return v


@dataclass
class Streams:
    core: Bits
    external: dict[int, Bytes]

    def of(self, id_: int) -> Bytes:
        if id_ not in self.external:
            raise ValueError(f"no external block {id_}")
        return self.external[id_]


Decoder = Callable[[Streams], object]


def _huffman(symbols: list[int], lengths: list[int]) -> Decoder:
    if len(symbols) == 1 and lengths[0] == 0:
        return lambda s: symbols[0]
    codes: dict[tuple[int, int], int] = {}
    code, last = 0, 0
    for length, symbol in sorted(zip(lengths, symbols)):
        code <<= length - last
        codes[length, code] = symbol
        code, last = code + 1, length

    def read(s: Streams) -> int:
        v = n = 0
        while True:
            v, n = v << 1 | s.core.take(1), n + 1
            if (n, v) in codes:
                return codes[n, v]
            if n > 32:
                raise ValueError("invalid code")

    return read


def _encoding(b: Bytes) -> tuple[int, Bytes]:
    codec = b.itf8()
    return codec, Bytes(b.take(b.itf8()))


def _integers(codec: int, p: Bytes, *, single: bool = False) -> Decoder:
    """Decoder of integers, or of single bytes."""
    if codec == 1:
        id_ = p.itf8()
        return (lambda s: s.of(id_).u8()) if single else (lambda s: s.of(id_).itf8())
    if codec == 3:
        symbols = [p.itf8() for _ in range(p.itf8())]
        return _huffman(symbols, [p.itf8() for _ in range(p.itf8())])
    if codec == 6:
        offset, n = p.itf8(), p.itf8()
        return lambda s: s.core.take(n) - offset
    if codec == 9:
        offset = p.itf8()

        def gamma(s: Streams) -> int:
            n = 0
            while s.core.take(1) == 0:
                n += 1
            return (1 << n | s.core.take(n)) - offset

        return gamma
    raise NotImplementedError(f"integer encoding {codec} is not supported")


def _arrays(codec: int, p: Bytes) -> Decoder:
    """Decoder of byte arrays that tell their own length."""
    if codec == 4:
        length, item = _integers(*_encoding(p)), _encoding(p)
        if item[0] == 1:
            id_ = item[1].itf8()
            return lambda s: s.of(id_).take(length(s))
        one = _integers(*item, single=True)
        return lambda s: bytes(one(s) for _ in range(length(s)))
    if codec == 5:
        stop, id_ = p.u8(), p.itf8()

        def until(s: Streams) -> bytes:
            b = s.of(id_)
            end = b.raw.index(bytes([stop]), b.at)
            out = b.raw[b.at : end]
            b.at = end + 1
            return out

        return until
    raise NotImplementedError(f"array encoding {codec} is not supported")


_BYTE = {"FC", "BA", "BS", "QS"}
_ARRAY = {"RN", "BB", "QQ", "IN", "SC"}
_BASES = "ACGTN"


@dataclass
class Compression:
    names_kept: bool = True
    delta: bool = True
    needs_reference: bool = True
    substitutions: list[str] = field(default_factory=lambda: ["CGTN", "AGTN", "ACTN", "ACGN", "ACGT"])
    tag_sets: list[list[tuple[str, str]]] = field(default_factory=lambda: [[]])
    series: dict[str, Decoder] = field(default_factory=dict)
    scores_block: int | None = None
    tags: dict[str, Decoder] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: bytes) -> Compression:
        b, c = Bytes(raw), cls()
        b.itf8()
        for _ in range(b.itf8()):
            key = b.take(2).decode()
            if key == "SM":
                c.substitutions = [cls._order(i, v) for i, v in enumerate(b.take(5))]
            elif key == "TD":
                raw_sets = b.take(b.itf8()).split(b"\0")[:-1]
                c.tag_sets = [[(s[i : i + 2].decode(), chr(s[i + 2])) for i in range(0, len(s), 3)] for s in raw_sets]
            else:
                v = bool(b.u8())
                if key == "RN":
                    c.names_kept = v
                elif key == "AP":
                    c.delta = v
                elif key == "RR":
                    c.needs_reference = v
        b.itf8()
        for _ in range(b.itf8()):
            key = b.take(2).decode()
            codec, p = _encoding(b)
            if codec == 0:
                continue
            if key in _ARRAY:
                c.series[key] = _arrays(codec, p)
            else:
                if key == "QS" and codec == 1:
                    c.scores_block = Bytes(p.raw).itf8()
                c.series[key] = _integers(codec, p, single=key in _BYTE)
        b.itf8()
        for _ in range(b.itf8()):
            key = b.itf8()
            c.tags[chr(key >> 16 & 255) + chr(key >> 8 & 255) + chr(key & 255)] = _arrays(*_encoding(b))
        return c

    @staticmethod
    def _order(i: int, packed: int) -> str:
        """Read bases by code, of reference base ``i``: two bits for each of the four others, in order."""
        others = _BASES.replace(_BASES[i], "")
        by = {packed >> (6 - 2 * k) & 3: base for k, base in enumerate(others)}
        return "".join(by.get(k, "N") for k in range(4))


@dataclass
class Slice:
    ref: int
    start: int
    span: int
    records: int
    counter: int
    embedded: int
    md5: bytes


def _slice_header(raw: bytes) -> tuple[Slice, int]:
    b = Bytes(raw)
    ref, start, span, n, counter, blocks = b.itf8(), b.itf8(), b.itf8(), b.itf8(), b.ltf8(), b.itf8()
    for _ in range(b.itf8()):
        b.itf8()
    embedded = b.itf8()
    return Slice(ref, start, span, n, counter, embedded, b.take(16)), blocks


class References:
    """Bases by name, the last sequence kept, from a provider of sequences.

    ``source``: an indexed or plain FASTA file, a folder or pattern of such files, or ``python:module:factory``, whose factory takes no argument
    and returns a function from a name to the bases (or None). A name that no file has raises.
    """

    def __init__(self, source: str | None) -> None:
        self.source, self.index, self.held = source, None, ("", "")

    def _provided(self, name: str) -> str | None:
        if self.source.startswith("python:"):
            if self.index is None:
                _, module, factory = self.source.split(":")
                self.index = getattr(importlib.import_module(module), factory)()
            return self.index(name)
        if self.index is None:
            self.index = {}
            for path in storage.listed(self.source, (".fa", ".fasta", ".fna")):
                if storage.exists(fai := f"{path}.fai"):
                    with storage.reading(fai) as f:
                        records = sequences.parse_fai(f.read().decode())
                else:
                    records = sequences.index_fasta(path)
                self.index |= {r.name: (path, r) for r in records}
        return sequences.fetch(*self.index[name]) if name in self.index else None

    def get(self, name: str) -> str:
        if self.source is None:
            raise ValueError("this file needs a reference")
        if self.held[0] != name:
            bases = self._provided(name)
            if bases is None:
                raise ValueError(f"the reference has no {name!r}")
            self.held = (name, bases.upper())
        return self.held[1]


def _container_rows(raw: bytes, names: list[str], groups: list[str], references: References) -> Iterator[tuple]:
    b = Bytes(raw)
    compression = Compression.parse(_block(b).data)
    while b.at < len(raw):
        head = _block(b)
        if head.kind != SLICE:
            raise ValueError("a slice header is expected")
        s, n = _slice_header(head.data)
        blocks = [_block(b) for _ in range(n)]
        core = next((x.data for x in blocks if x.kind == CORE), b"")
        external = {x.id: x.data for x in blocks if x.kind == EXTERNAL}
        yield from _SliceRecords(s, compression, core, external, names, groups, references).rows()


class _Record:
    __slots__ = ("flags", "bits", "ref", "pos", "length", "group", "name", "mate_ref", "mate_pos", "tlen", "next", "tags", "features", "mapq", "scores", "seq", "cigar", "end")


class _SliceRecords:
    def __init__(self, s: Slice, c: Compression, core: bytes, external: dict[int, bytes], names: list[str], groups: list[str], references: References) -> None:
        self.s, self.c, self.names, self.groups, self.references = s, c, names, groups, references
        self.streams = Streams(Bits(core), {k: Bytes(v) for k, v in external.items()})
        self.embedded = external.get(s.embedded) if s.embedded >= 0 else None
        if c.needs_reference and s.ref >= 0 and self.embedded is None and any(s.md5):
            part = references.get(names[s.ref])[s.start - 1 : s.start - 1 + s.span]
            if hashlib.md5(part.encode()).digest() != s.md5:
                raise ValueError(f"the reference of {names[s.ref]} has another checksum")

    def get(self, key: str):
        return self.c.series[key](self.streams)

    def rows(self) -> Iterator[tuple]:
        records, last = [], self.s.start
        for i in range(self.s.records):
            r = self._record(last, i)
            last = r.pos
            records.append(r)
        self._mates(records)
        for r in records:
            yield self._row(r)

    def _record(self, last: int, i: int) -> _Record:
        get, c, s = self.get, self.c, self.s
        r = _Record()
        r.flags, r.bits = get("BF"), get("CF")
        r.ref = get("RI") if s.ref == -2 else s.ref
        r.length = get("RL")
        r.pos = last + get("AP") if c.delta else get("AP")
        r.group = get("RG")
        r.name = get("RN").decode() if c.names_kept else None
        r.mate_ref, r.mate_pos, r.tlen, r.next = -1, 0, 0, None
        if r.bits & DETACHED:
            mate = get("MF")
            if mate & MATE_REVERSE:
                r.flags |= 0x20
            if mate & MATE_UNMAPPED:
                r.flags |= 0x8
            if not c.names_kept:
                r.name = get("RN").decode()
            r.mate_ref, r.mate_pos, r.tlen = get("NS"), get("NP"), get("TS")
        elif r.bits & DOWNSTREAM:
            r.next = i + get("NF") + 1
        if r.name is None:
            r.name = str(s.counter + i + 1)
        raw = b"".join(t.encode() + ty.encode() + c.tags[t + ty](self.streams) for t, ty in c.tag_sets[get("TL")])
        r.tags = bam.decode_tags(raw, 0)
        r.scores = None
        if r.flags & 4:
            r.features, r.mapq, r.cigar, r.end = [], 255, "", r.pos
            r.seq = "" if r.bits & NO_BASES else "".join(chr(get("BA")) for _ in range(r.length))
            if r.bits & HAS_SCORES:
                r.scores = bytearray(self._scores(r.length))
            return r
        r.features = self._features()
        r.mapq = get("MQ")
        if r.bits & HAS_SCORES:
            r.scores = bytearray(self._scores(r.length))
        self._resolve(r)
        return r

    def _scores(self, n: int) -> bytes:
        if self.c.scores_block is not None:
            return self.streams.of(self.c.scores_block).take(n)
        return bytes(self.get("QS") for _ in range(n))

    def _features(self) -> list[tuple[str, int, object]]:
        get, out, at = self.get, [], 0
        for _ in range(get("FN")):
            code = chr(get("FC"))
            at += get("FP")
            single = {"X": "BS", "i": "BA", "D": "DL", "N": "RS", "P": "PD", "H": "HC", "Q": "QS", "S": "SC", "I": "IN", "b": "BB", "q": "QQ"}
            if code == "B":
                out.append((code, at, (get("BA"), get("QS"))))
            elif code in single:
                out.append((code, at, get(single[code])))
            else:
                raise ValueError(f"invalid feature {code!r}")
        return out

    def _reference(self, r: _Record) -> Callable[[int, int], str]:
        """Reference bases from a position on, as many as asked for."""
        if self.embedded is not None:
            text, first = self.embedded.decode().upper(), self.s.start
        elif not self.c.needs_reference:
            return lambda at, n: "N" * n
        else:
            text, first = self.references.get(self.names[r.ref]), 1
        return lambda at, n: text[at - first : at - first + n].ljust(n, "N")

    def _resolve(self, r: _Record) -> None:
        """Bases, CIGAR and end of a mapped record from its features."""
        ops: list[list] = []
        seq: list[str] = []
        done, at = 0, r.pos  # bases of the read so far, and the next reference position

        def op(kind: str, n: int) -> None:
            if n and ops and ops[-1][1] == kind:
                ops[-1][0] += n
            elif n:
                ops.append([n, kind])

        reference = None

        def match(n: int) -> None:
            nonlocal done, at, reference
            if n <= 0:
                return
            if not r.bits & NO_BASES:
                reference = reference or self._reference(r)
                seq.append(reference(at, n))
            op("M", n)
            done, at = done + n, at + n

        for code, spot, v in r.features:
            if code in "qQ":
                continue
            match(spot - 1 - done)
            if code in "bB":
                text = v.decode() if code == "b" else chr(v[0])
                seq.append(text)
                op("M", len(text))
                done, at = done + len(text), at + len(text)
            elif code == "X":
                reference = reference or self._reference(r)
                base = reference(at, 1)
                seq.append(self.c.substitutions[_BASES.find(base) if base in _BASES else 4][v])
                op("M", 1)
                done, at = done + 1, at + 1
            elif code in "ISi":
                text = chr(v) if code == "i" else v.decode()
                seq.append(text)
                op("S" if code == "S" else "I", len(text))
                done += len(text)
            elif code in "DN":
                op(code, v)
                at += v
            else:
                op(code, v)
        match(r.length - done)
        r.cigar = "".join(f"{n}{k}" for n, k in ops)
        r.end = max(at - 1, r.pos)
        r.seq = "" if r.bits & NO_BASES else "".join(seq)
        for code, spot, v in r.features:
            if code in "BQq":
                r.scores = r.scores if r.scores is not None else bytearray(b"\xff" * r.length)
                values = v if code == "q" else bytes([v[1] if code == "B" else v])
                r.scores[spot - 1 : spot - 1 + len(values)] = values

    def _mates(self, records: list[_Record]) -> None:
        """Records chained by distance are mates of each other: fields follow from the chain."""
        inner = {r.next for r in records if r.next is not None}
        for i, first in enumerate(records):
            if first.next is None or i in inner:
                continue
            chain = [first]
            while chain[-1].next is not None:
                chain.append(records[chain[-1].next])
            for a, m in zip(chain, [*chain[1:], first]):
                a.mate_ref, a.mate_pos = m.ref, m.pos
                a.flags |= (0x20 if m.flags & 0x10 else 0) | (0x8 if m.flags & 0x4 else 0)
                if not self.c.names_kept:
                    a.name = first.name
            if all(r.ref == first.ref and not r.flags & 4 for r in chain):
                left, right = min(r.pos for r in chain), max(r.end for r in chain)
                size = right - left + 1
                lead = min(range(len(chain)), key=lambda k: (chain[k].pos, not chain[k].flags & 0x40))
                for k, r in enumerate(chain):
                    r.tlen = size if k == lead else -size

    def _row(self, r: _Record) -> tuple:
        name = lambda i: self.names[i] if i is not None and i >= 0 else None
        tags = r.tags
        if r.group >= 0 and not any(t == "RG" for t, _ in tags):
            tags = [*tags, ("RG", bam._value("Z", s=self.groups[r.group]))]
        qual = None if r.scores is None or not r.seq or all(q == 255 for q in r.scores) else bytes(q + 33 & 127 for q in r.scores).decode("ascii")
        return (
            None if r.name == "*" else r.name, r.flags, name(r.ref), r.pos if r.pos > 0 else None, None if r.mapq == 255 else r.mapq, r.cigar or None,
            name(r.mate_ref), r.mate_pos if r.mate_pos > 0 else None, r.tlen, r.seq or None, qual, tags,
        )


# writing ------------------------------------------------------------------------------------


def _pack_block(kind: int, id_: int, data: bytes, method: int) -> bytes:
    body = entropy.compress(method, data)
    if len(body) >= len(data):
        method, body = entropy.RAW, data
    out = bytes([method, kind]) + itf8(id_) + itf8(len(body)) + itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out))


def _pack_container(ref: int, start: int, span: int, n: int, counter: int, bases: int, blocks: list[bytes], landmarks: list[int]) -> bytes:
    body = b"".join(blocks)
    head = struct.pack("<i", len(body)) + itf8(ref) + itf8(start) + itf8(span) + itf8(n) + ltf8(counter) + ltf8(bases) + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + body


_IDS = {k: i for i, k in enumerate("BF CF RI RL AP RG RN MF NS NP TS TL FN FC FP DL BA QS BS IN RS PD HC SC MQ BB QQ".split(), 1)}


class _SliceWriter:
    """Rows as one slice in one container; bases stand in the records, so no reference is needed."""

    def __init__(self, rows: list[tuple], names: dict[str, int], groups: dict[str, int], counter: int) -> None:
        self.out: dict[str, bytearray] = {k: bytearray() for k in _IDS}
        self.tag_out: dict[str, bytearray] = {}
        self.tag_sets: dict[str, int] = {}
        self.names, self.groups, self.counter = names, groups, counter
        refs = {names[r[2]] if r[2] is not None else -1 for r in rows}
        self.ref = refs.pop() if len(refs) == 1 else -2
        self.bases = 0
        placed = [(r[3], r[3] + max(bam._span(bam._operations(r[5])), 1) - 1) for r in rows if r[3]]
        self.start = min((a for a, _ in placed), default=0) if self.ref >= 0 else 0
        self.span = max((z for _, z in placed), default=0) - self.start + 1 if self.ref >= 0 and placed else 0
        self.n = len(rows)
        for r in rows:
            self._add(r)

    def _int(self, key: str, v: int) -> None:
        self.out[key] += itf8(v)

    def _array(self, key: str, v: bytes) -> None:
        self.out[key] += v + b"\0"

    def _add(self, row: tuple) -> None:
        name, flags, rname, pos, mapq, cigar, mate_rname, mate_pos, tlen, seq, qual, tags = row
        seq = seq or ""
        if rname is not None and rname not in self.names or mate_rname is not None and mate_rname not in self.names:
            raise ValueError(f"{rname!r} or {mate_rname!r} is not in the dictionary")
        ops = bam._operations(cigar)
        length = len(seq) or sum(o >> 4 for o in ops if o & 15 in (0, 1, 4, 7, 8))
        bits = DETACHED | (HAS_SCORES if qual and seq else 0) | (0 if seq else NO_BASES)
        self._int("BF", flags & ~0x28)
        self._int("CF", bits)
        if self.ref == -2:
            self._int("RI", self.names[rname] if rname is not None else -1)
        self._int("RL", length)
        self._int("AP", pos or 0)
        tags = tags.items() if isinstance(tags, dict) else tags or []
        group = next((v["s"] for t, v in tags if t == "RG"), None)
        self._int("RG", self.groups.get(group, -1))
        self._array("RN", (name or "*").encode())
        self._int("MF", (MATE_REVERSE if flags & 0x20 else 0) | (MATE_UNMAPPED if flags & 0x8 else 0))
        self._int("NS", self.names[mate_rname] if mate_rname is not None else -1)
        self._int("NP", mate_pos or 0)
        self._int("TS", tlen or 0)
        line = ""
        for t, v in tags:
            if t == "RG" and group in self.groups:
                continue
            raw = bam.encode_tags([(t, v)])
            key = raw[:3].decode("latin-1")
            line += key
            self.tag_out.setdefault(key, bytearray()).extend(itf8(len(raw) - 3) + raw[3:])
        self._int("TL", self.tag_sets.setdefault(line, len(self.tag_sets)))
        self.bases += length
        if flags & 4:
            self.out["BA"] += seq.encode()
        else:
            self._features(ops, seq)
            self._int("MQ", 255 if mapq is None else mapq)
        if bits & HAS_SCORES:
            self.out["QS"] += bytes(ord(c) - 33 for c in qual)

    def _features(self, ops: list[int], seq: str) -> None:
        found: list[tuple[str, int, object]] = []
        at = 1
        for o in ops:
            n, kind = o >> 4, bam._OPS[o & 15]
            text = seq[at - 1 : at - 1 + n]
            if kind in "M=X":
                if seq:
                    found.append(("b", at, text))
                at += n
            elif kind in "IS":
                found.append((kind, at, text if seq else "N" * n))
                at += n
            else:
                found.append((kind, at, n))
        self._int("FN", len(found))
        last = 0
        for code, spot, v in found:
            self.out["FC"].append(ord(code))
            self._int("FP", spot - last)
            last = spot
            key = {"b": "BB", "I": "IN", "S": "SC", "D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code]
            if isinstance(v, str):
                self._array(key, v.encode())
            else:
                self._int(key, v)

    def pack(self, method: int) -> bytes:
        td = b"".join(k.encode("latin-1") + b"\0" for k in self.tag_sets) or b"\0"
        keep = itf8(5) + b"RN\1" + b"AP\0" + b"RR\0" + b"SM" + bytes([0x1B] * 5) + b"TD" + itf8(len(td)) + td
        external = lambda i: itf8(1) + itf8(len(itf8(i))) + itf8(i)
        stop = lambda i: itf8(5) + itf8(1 + len(itf8(i))) + b"\0" + itf8(i)
        series = itf8(len(_IDS)) + b"".join(k.encode() + (stop(i) if k in _ARRAY else external(i)) for k, i in _IDS.items())
        tag_ids = {k: ord(k[0]) << 16 | ord(k[1]) << 8 | ord(k[2]) for k in self.tag_out}
        tags = itf8(len(tag_ids)) + b"".join(itf8(i) + itf8(4) + itf8(2 * len(external(i))) + external(i) * 2 for i in tag_ids.values())
        head = b"".join(itf8(len(x)) + x for x in (keep, series, tags))
        blocks = {_IDS[k]: bytes(v) for k, v in self.out.items() if v} | {tag_ids[k]: bytes(v) for k, v in self.tag_out.items()}
        data = [_pack_block(CORE, 0, b"", entropy.RAW), *(_pack_block(EXTERNAL, i, v, method) for i, v in blocks.items())]
        slice_ = itf8(self.ref) + itf8(self.start) + itf8(self.span) + itf8(self.n) + ltf8(self.counter) + itf8(len(data)) + itf8(len(blocks)) + b"".join(map(itf8, blocks)) + itf8(-1) + bytes(16)
        first = _pack_block(COMPRESSION, 0, head, method)
        return _pack_container(self.ref, self.start, self.span, self.n, self.counter, self.bases, [first, _pack_block(SLICE, 0, slice_, entropy.RAW), *data], [len(first)])


def write_to(f: BinaryIO, rows: Iterator[tuple], header: SamHeader, *, method: int = entropy.GZIP) -> None:
    """Rows into a file of slices of ``SLICE_RECORDS`` records; ``method`` compresses the blocks."""
    names, groups = ({n: i for i, n in enumerate(x)} for x in (header.sequences, header.groups))
    minor = 1 if method > entropy.RANS4 else 0
    text = str(header).encode()
    f.write(b"CRAM\3" + bytes([minor]) + bytes(20))
    f.write(_pack_container(0, 0, 0, 0, 0, 0, [_pack_block(HEADER, 0, struct.pack("<i", len(text)) + text, entropy.RAW)], [0]))
    held: list[tuple] = []
    counter = 0

    def flush() -> None:
        nonlocal counter
        if held:
            f.write(_SliceWriter(held, names, groups, counter).pack(method))
            counter += len(held)
            held.clear()

    for row in rows:
        held.append(tuple(row))
        if len(held) == SLICE_RECORDS:
            flush()
    flush()
    f.write(EOF)


def build_crai(path: str, reference: str | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Index rows of a file: reference, start, span, container offset, landmark, slice size; one per slice and reference."""
    out = []
    with storage.reading(path) as f:
        header = _open(f)
        at = f.tell()
        for c in containers(f):
            raw = _read(f, c)
            b = Bytes(raw)
            _block(b)
            while b.at < len(raw):
                landmark = b.at
                s, n = _slice_header(_block(b).data)
                for _ in range(n):
                    _block(b)
                if s.ref != -2:
                    out.append((s.ref, s.start, s.span, at, landmark, b.at - landmark))
                    continue
                found: dict[int, list[int]] = {}
                names, groups = list(header.sequences), list(header.groups)
                for row in _container_rows(raw, names, groups, References(reference)):
                    ref = names.index(row[2]) if row[2] is not None else -1
                    a = row[3] or 0
                    z = a + max(bam._span(bam._operations(row[5])), 1) - 1 if a else 0
                    m = found.setdefault(ref, [a, z])
                    m[0], m[1] = min(m[0], a), max(m[1], z)
                out += [(ref, a, z - a + 1 if a else 0, at, landmark, b.at - landmark) for ref, (a, z) in sorted(found.items(), key=lambda x: (x[0] < 0, x[0]))]
            at = c.offset + c.size
    return out


def write_crai(path: str, reference: str | None = None) -> str:
    """Index a file beside it."""
    rows = build_crai(path, reference)
    with storage.writing(f"{path}.crai") as f:
        f.write(gzip.compress("".join("\t".join(map(str, r)) + "\n" for r in rows).encode()))
    return f"{path}.crai"


def _read(f, c: Container) -> bytes:
    f.seek(c.offset)
    raw = f.read(c.size)
    if len(raw) < c.size:
        raise ValueError("truncated container")
    f.seek(c.offset + c.size)
    return raw


# data source --------------------------------------------------------------------------------


class _Piece(InputPartition):
    def __init__(self, path: str, bodies: list[tuple[int, int]]) -> None:
        self.path, self.bodies = path, bodies


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = storage.listed(options["path"], (".cram",))
        self.reference = options.get("reference") or None
        self.region = Region.parse(options["region"]) if options.get("region") else None
        self.task_bytes = int(options.get("task_bytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            with storage.reading(p) as f:
                names = list(_open(f).sequences)
                held: list[tuple[int, int]] = []
                indexed = self._indexed(p, names) if self.region else None
                for c in containers(f) if indexed is None else containers_at(f, indexed):
                    if self.region and not self._may_hold(c, names):
                        continue
                    held.append((c.offset, c.size))
                    if sum(n for _, n in held) >= self.task_bytes:
                        out.append(_Piece(p, held))
                        held = []
                if held:
                    out.append(_Piece(p, held))
        return out or [_Piece("", [])]

    def _indexed(self, path: str, names: list[str]) -> list[int] | None:
        """Offsets of the containers that an index beside the file (``.crai``) names for the region."""
        if not storage.exists(f"{path}.crai"):
            return None
        with storage.reading(f"{path}.crai") as f:
            rows = [[int(x) for x in line.split("\t")] for line in gzip.decompress(f.read()).decode().splitlines() if line]
        r = self.region
        return sorted({at for ref, start, span, at, *_ in rows if 0 <= ref < len(names) and names[ref] == r.name and (r.end is None or start <= r.end) and (r.start is None or start + span - 1 >= r.start)})

    def _may_hold(self, c: Container, names: list[str]) -> bool:
        r = self.region
        if c.ref == -2:
            return True
        if c.ref < 0 or names[c.ref] != r.name:
            return False
        return (r.end is None or c.start <= r.end) and (r.start is None or c.start + c.span - 1 >= r.start)

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        references = References(self.reference)
        with storage.reading(partition.path) as f:
            header = _open(f)
            names, groups = list(header.sequences), list(header.groups)
            for offset, size in partition.bodies:
                f.seek(offset)
                rows = list(_container_rows(f.read(size), names, groups, references))
                if rows:
                    yield bam._batch(rows)


class _Writer(storage.PartsWriter):
    ending = ".cram"

    def encode(self, batches: Iterator[pa.RecordBatch], out: BinaryIO) -> None:
        rows = (tuple(r[f.name] for f in bam.ARROW) for b in batches for r in b.to_pylist())
        write_to(out, rows, SamHeader.parse(self.options["header"]), method=int(self.options.get("method", entropy.GZIP)))


class CramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_cram"

    def schema(self) -> str:
        return bam.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_cram(spark: SparkSession, path: str, *, reference: str | None = None, region: str | None = None) -> DataFrame:
    """Alignments of a file, a folder or a pattern; of a region exactly those that overlap it, each once."""
    spark.dataSource.register(CramSource)
    reader = spark.read.format("strandline_cram").option("path", path).option("reference", reference or "")
    if region is None:
        return reader.load()
    df = reader.option("region", region).load()
    return df.where(Region.parse(region).overlaps(F.col("rname"), F.col("pos"), cg.alignment_end(F.col("pos"), F.col("cigar"))))


def write_cram(df: DataFrame, path: str, header: SamHeader, *, method: int = entropy.GZIP, mode: str = "append") -> None:
    """One file per partition in the folder ``path``, named when all are complete."""
    df.sparkSession.dataSource.register(CramSource)
    df.select(*[f.name for f in bam.ARROW]).write.format("strandline_cram").option("header", str(header)).option("method", str(method)).mode(mode).save(path)
