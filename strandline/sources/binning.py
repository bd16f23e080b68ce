"""Binning indexes of block-compressed files: BAI, CSI and TBI, one model for all."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from strandline.functions import bins as B


@dataclass
class Reference:
    """Bins with their chunks (virtual positions), the least offset of bins or windows, and counts."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    windows: list[int] = field(default_factory=list)
    bin_offsets: dict[int, int] = field(default_factory=dict)
    metadata: tuple[int, int, int, int] | None = None  # first position, last position, mapped, unmapped


@dataclass
class TextHeader:
    """Which fields of tab-separated lines hold the coordinates."""

    format: int = 0
    sequence: int = 1
    start: int = 2
    end: int = 0
    comment: str = "#"
    skip: int = 0
    names: list[str] = field(default_factory=list)


#: Presets of the generic index for the text formats (format code, 1-based fields).
PRESETS = {"bed": (0x10000, 1, 2, 3, "#"), "gff": (0, 1, 4, 5, "#"), "sam": (1, 3, 4, 0, "@"), "vcf": (2, 1, 2, 0, "#")}


def preset(name: str, names: list[str]) -> TextHeader:
    code, seq, start, end, comment = PRESETS[name]
    return TextHeader(code, seq, start, end, comment, 0, names)


@dataclass
class Index:
    references: list[Reference] = field(default_factory=list)
    unplaced: int | None = None
    min_shift: int = B.MIN_SHIFT
    depth: int = B.DEPTH
    header: TextHeader | None = None

    def query(self, reference: int, start: int | None = None, end: int | None = None) -> list[tuple[int, int]]:
        """Merged chunks that may hold records overlapping ``start`` .. ``end``."""
        top = B.max_position(self.min_shift, self.depth)
        lo, hi = start or 1, end or top
        if lo > top or hi > top:
            raise ValueError(f"positions beyond {top} can't be indexed with this depth")
        r = self.references[reference]
        chunks = [c for b in B.plain_reg2bins(lo, hi, self.min_shift, self.depth) for c in r.bins.get(b, ())]
        return merge([c for c in sorted(chunks) if c[1] > self.least_offset(r, lo)])

    def least_offset(self, r: Reference, start: int) -> int:
        if r.windows:
            w = (start - 1) >> self.min_shift
            return r.windows[w] if w < len(r.windows) else 0
        b = B.plain_reg2bin(start, start, self.min_shift, self.depth)
        while b and b not in r.bin_offsets:
            b = (b - 1) >> 3
        return r.bin_offsets.get(b, 0)

    def last_position(self) -> int | None:
        """The last indexed position; records without a reference follow it."""
        ends = [c[1] for r in self.references for cs in r.bins.values() for c in cs]
        return max(ends, default=None)


def merge(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted chunks with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, z in chunks:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


class Builder:
    """Builds an index from records in coordinate order."""

    def __init__(self, references: int, *, min_shift: int = B.MIN_SHIFT, depth: int = B.DEPTH, csi: bool = False) -> None:
        self.index = Index([Reference() for _ in range(references)], 0, min_shift, depth)
        self.csi, self.last = csi, 0
        self.seen: dict[int, list[int]] = {}

    def add(self, reference: int | None, start: int | None, end: int | None, mapped: bool, chunk: tuple[int, int]) -> None:
        if reference is None or start is None:
            self.index.unplaced += 1
            return
        if reference < self.last:
            raise ValueError("records are not in order of their references")
        self.last = reference
        r, (a, z) = self.index.references[reference], chunk
        b = B.plain_reg2bin(start, end, self.index.min_shift, self.index.depth)
        held = r.bins.setdefault(b, [])
        if held and held[-1][1] >= a:
            held[-1] = (held[-1][0], max(z, held[-1][1]))
        else:
            held.append((a, z))
        r.bin_offsets[b] = min(r.bin_offsets.get(b, a), a)
        if not self.csi:
            for w in range((start - 1) >> self.index.min_shift, ((end - 1) >> self.index.min_shift) + 1):
                while len(r.windows) <= w:
                    r.windows.append(-1)
                if r.windows[w] < 0 or a < r.windows[w]:
                    r.windows[w] = a
        m = self.seen.setdefault(reference, [a, z, 0, 0])
        m[0], m[1] = min(m[0], a), max(m[1], z)
        m[2 if mapped else 3] += 1

    def finish(self) -> Index:
        for i, m in self.seen.items():
            self.index.references[i].metadata = tuple(m)
        for r in self.index.references:
            least = 0
            for w, offset in enumerate(r.windows):  # windows without records take the one before
                least = offset if offset >= 0 else least
                r.windows[w] = least
        return self.index


class _Cursor:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, fmt: str) -> tuple:
        s = struct.Struct("<" + fmt)
        if self.at + s.size > len(self.raw):
            raise ValueError("truncated index")
        out = s.unpack_from(self.raw, self.at)
        self.at += s.size
        return out

    def bytes(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out


def _bins(c: _Cursor, r: Reference, depth: int, offsets: bool) -> None:
    for _ in range(c.take("i")[0]):
        (b,) = c.take("I")
        loffset = c.take("Q")[0] if offsets else None
        chunks = [c.take("QQ") for _ in range(c.take("i")[0])]
        if b == B.metadata_bin(depth):
            r.metadata = (*chunks[0], *chunks[1])
        else:
            r.bins[b] = chunks
            if offsets:
                r.bin_offsets[b] = loffset


def _windows(c: _Cursor, r: Reference) -> None:
    (n,) = c.take("i")
    r.windows = list(c.take(f"{n}Q"))


def _text_header(c: _Cursor) -> TextHeader:
    code, seq, start, end, comment, skip, size = c.take("7i")
    names = c.bytes(size).split(b"\0")[:-1]
    return TextHeader(code, seq, start, end, chr(comment), skip, [n.decode() for n in names])


def _rest(c: _Cursor) -> int | None:
    return c.take("Q")[0] if len(c.raw) - c.at >= 8 else None


def parse_bai(raw: bytes) -> Index:
    c = _Cursor(raw)
    if c.bytes(4) != b"BAI\1":
        raise ValueError("no BAI index")
    index = Index()
    for _ in range(c.take("i")[0]):
        r = Reference()
        _bins(c, r, B.DEPTH, False)
        _windows(c, r)
        index.references.append(r)
    index.unplaced = _rest(c)
    return index


def parse_tbi(raw: bytes) -> Index:
    """From the uncompressed bytes of a TBI file."""
    c = _Cursor(raw)
    if c.bytes(4) != b"TBI\1":
        raise ValueError("no TBI index")
    (n,) = c.take("i")
    index = Index(header=_text_header(c))
    for _ in range(n):
        r = Reference()
        _bins(c, r, B.DEPTH, False)
        _windows(c, r)
        index.references.append(r)
    index.unplaced = _rest(c)
    return index


def parse_csi(raw: bytes) -> Index:
    """From the uncompressed bytes of a CSI file."""
    c = _Cursor(raw)
    if c.bytes(4) != b"CSI\1":
        raise ValueError("no CSI index")
    min_shift, depth, size = c.take("3i")
    header = _text_header(_Cursor(c.bytes(size))) if size else None
    index = Index(min_shift=min_shift, depth=depth, header=header)
    for _ in range(c.take("i")[0]):
        r = Reference()
        _bins(c, r, depth, True)
        index.references.append(r)
    index.unplaced = _rest(c)
    return index


def _write_bins(r: Reference, depth: int, offsets: bool) -> bytes:
    out = [struct.pack("<i", len(r.bins) + (r.metadata is not None))]
    for b, chunks in sorted(r.bins.items()):
        out.append(struct.pack("<I", b))
        if offsets:
            out.append(struct.pack("<Q", r.bin_offsets.get(b, 0)))
        out.append(struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks))
    if r.metadata is not None:
        out.append(struct.pack("<I", B.metadata_bin(depth)) + (struct.pack("<Q", 0) if offsets else b"") + struct.pack("<i4Q", 2, *r.metadata))
    return b"".join(out)


def _write_header(h: TextHeader) -> bytes:
    names = b"".join(n.encode() + b"\0" for n in h.names)
    return struct.pack("<7i", h.format, h.sequence, h.start, h.end, ord(h.comment), h.skip, len(names)) + names


def _tail(index: Index) -> bytes:
    return b"" if index.unplaced is None else struct.pack("<Q", index.unplaced)


def bai_bytes(index: Index) -> bytes:
    out = [b"BAI\1", struct.pack("<i", len(index.references))]
    for r in index.references:
        out += [_write_bins(r, B.DEPTH, False), struct.pack(f"<i{len(r.windows)}Q", len(r.windows), *r.windows)]
    return b"".join([*out, _tail(index)])


def tbi_bytes(index: Index) -> bytes:
    out = [b"TBI\1", struct.pack("<i", len(index.references)), _write_header(index.header)]
    for r in index.references:
        out += [_write_bins(r, B.DEPTH, False), struct.pack(f"<i{len(r.windows)}Q", len(r.windows), *r.windows)]
    return b"".join([*out, _tail(index)])


def csi_bytes(index: Index) -> bytes:
    head = _write_header(index.header) if index.header else b""
    out = [b"CSI\1", struct.pack("<3i", index.min_shift, index.depth, len(head)), head, struct.pack("<i", len(index.references))]
    out += [_write_bins(r, index.depth, True) for r in index.references]
    return b"".join([*out, _tail(index)])
