"""Blocked gzip: independent members of at most 64 KiB, addressed by virtual positions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed value: the empty block that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEADER = struct.Struct("<4BI2BH2BHH")
MAX_DATA = 65280


def _size(head: bytes) -> int:
    """Size of the block whose first 18 bytes are given."""
    magic1, magic2, method, flags, _, _, _, extra, s1, s2, length, size = HEADER.unpack(head)
    if (magic1, magic2, method) != (31, 139, 8) or not flags & 4 or (s1, s2, length) != (66, 67, 2):
        raise ValueError("not a block of blocked gzip")
    return size + 1


def read_block(f: BinaryIO) -> tuple[bytes, int] | None:
    """The data of the next block and its size in the file; None at the end. The checksum is verified."""
    head = f.read(HEADER.size)
    if not head:
        return None
    if len(head) < HEADER.size:
        raise ValueError("truncated block header")
    size = _size(head)
    rest = f.read(size - HEADER.size)
    if len(rest) < size - HEADER.size:
        raise ValueError("truncated block")
    data = zlib.decompress(rest[:-8], wbits=-15)
    crc, length = struct.unpack("<2I", rest[-8:])
    if zlib.crc32(data) != crc or len(data) != length:
        raise ValueError("block checksum mismatch")
    return data, size


def block_offsets(f: BinaryIO) -> Iterator[int]:
    """Offsets of all blocks, from their headers only."""
    at = 0
    f.seek(0)
    while len(head := f.read(HEADER.size)) == HEADER.size:
        yield at
        at += _size(head)
        f.seek(at)


class Reader:
    """Uncompressed bytes with seeking by virtual position (``coffset << 16 | uoffset``)."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.at, self.next, self.data, self.pos = f, f.tell(), f.tell(), b"", 0

    def _advance(self) -> bool:
        while True:
            self.at = self.next
            got = read_block(self.f)
            if got is None:
                self.data, self.pos = b"", 0
                return False
            self.data, size = got
            self.next, self.pos = self.at + size, 0
            if self.data:
                return True

    @property
    def position(self) -> int:
        if self.pos >= len(self.data) and self.data:
            return self.next << 16
        return self.at << 16 | self.pos

    def seek(self, position: int) -> None:
        self.f.seek(position >> 16)
        self.next = position >> 16
        self.data, self.pos = b"", 0
        if self._advance():
            self.pos = position & 0xFFFF

    def read(self, n: int = -1) -> bytes:
        out: list[bytes] = []
        while n != 0:
            if self.pos >= len(self.data) and not self._advance():
                break
            piece = self.data[self.pos :] if n < 0 else self.data[self.pos : self.pos + n]
            self.pos += len(piece)
            n -= len(piece) if n > 0 else 0
            out.append(piece)
        return b"".join(out)


class Plain:
    """Bytes that are not compressed, with the reader's interface; positions are bytes."""

    def __init__(self, f: BinaryIO) -> None:
        self.f = f

    @property
    def position(self) -> int:
        return self.f.tell()

    def seek(self, position: int) -> None:
        self.f.seek(position)

    def read(self, n: int = -1) -> bytes:
        return self.f.read(n)


def opened(f: BinaryIO) -> Reader | Plain:
    """A reader of a file that is made of blocks or, by its first bytes, is not compressed at all."""
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return Reader(f) if packed else Plain(f)


def compress_block(data: bytes, level: int = 6) -> bytes:
    """One block of at most ``MAX_DATA`` bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) + 26 > 65536:
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    return HEADER.pack(31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


class Writer:
    """Blocks of the bytes written; ``position`` is the virtual position of the next byte."""

    def __init__(self, f: BinaryIO, level: int = 6) -> None:
        self.f, self.level, self.buffer, self.at = f, level, bytearray(), 0
        self.index: list[tuple[int, int]] = []  # starts of blocks after the first: compressed, uncompressed
        self.done = 0

    @property
    def position(self) -> int:
        return self.at << 16 | len(self.buffer)

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= MAX_DATA:
            self._flush(MAX_DATA)

    def _flush(self, n: int) -> None:
        block = compress_block(bytes(self.buffer[:n]), self.level)
        self.f.write(block)
        self.at += len(block)
        self.done += n
        del self.buffer[:n]
        self.index.append((self.at, self.done))

    def close(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer))
        self.f.write(EOF)


def has_eof(f: BinaryIO) -> bool:
    """Whether a file ends with the empty block."""
    f.seek(0, 2)
    if f.tell() < len(EOF):
        return False
    f.seek(-len(EOF), 2)
    return f.read() == EOF


# the index by uncompressed offset (GZI)


def gzi_bytes(index: list[tuple[int, int]]) -> bytes:
    return struct.pack("<Q", len(index)) + b"".join(struct.pack("<2Q", *x) for x in index)


def parse_gzi(raw: bytes) -> list[tuple[int, int]]:
    (n,) = struct.unpack_from("<Q", raw)
    if len(raw) != 8 + 16 * n:
        raise ValueError("the index has another length than it says")
    return [struct.unpack_from("<2Q", raw, 8 + 16 * i) for i in range(n)]


def gzi_position(index: list[tuple[int, int]], uncompressed: int) -> int:
    """Virtual position of an uncompressed offset."""
    import bisect

    at = bisect.bisect_right(index, uncompressed, key=lambda x: x[1]) - 1
    c, u = index[at] if at >= 0 else (0, 0)
    return c << 16 | (uncompressed - u)


def read_at(f: BinaryIO, index: list[tuple[int, int]], offset: int, length: int) -> bytes:
    """``length`` uncompressed bytes from an uncompressed offset on, without reading what lies before."""
    r = Reader(f)
    r.seek(gzi_position(index, offset))
    return r.read(length)
