"""Codecs of whole record fields in compressed alignment blocks: read names by tokens, and quality scores by context."""

from __future__ import annotations

import re
import struct

from strandline.sources.entropy import Bytes, RangeDecoder, _Model, nx16_decode, nx16_encode, range_decode, vlq

#: Kinds of tokens.
TYPE, ALPHA, CHAR, DIGITS0, DZLEN, DUP, DIFF, DIGITS, DELTA, DELTA0, MATCH, NOP, END = range(13)


# names --------------------------------------------------------------------------------------


class _Tokens:
    """Streams by token position and kind."""

    def __init__(self) -> None:
        self.streams: list[dict[int, Bytes]] = []

    def byte(self, at: int, kind: int) -> int:
        return self.streams[at][kind].u8()

    def word(self, at: int, kind: int) -> int:
        return self.streams[at][kind].unpack("I")[0]

    def text(self, at: int) -> bytes:
        b = self.streams[at][ALPHA]
        end = b.raw.index(0, b.at)
        out = b.raw[b.at : end]
        b.at = end + 1
        return out


def names_decode(raw: bytes) -> bytes:
    """Names, each followed by a zero byte."""
    b = Bytes(raw)
    _, count = b.unpack("II")
    decode = range_decode if b.u8() else nx16_decode
    held = _Tokens()
    while b.at < len(raw):
        kind = b.u8()
        what = kind & 0x3F
        if kind & 0x80:
            held.streams.append({})
            if what != TYPE:
                held.streams[-1][TYPE] = Bytes(bytes([what]) + bytes([MATCH]) * (count - 1))
        if kind & 0x40:
            at, other = b.u8(), b.u8()
            held.streams[-1][what] = Bytes(held.streams[at][other].raw)
        else:
            held.streams[-1][what] = Bytes(decode(b.take(b.vlq())))
    done: list[list[bytes]] = []
    out = bytearray()
    for n in range(count):
        kind = held.byte(0, TYPE)
        before = done[n - distance] if (distance := held.word(0, kind)) else []
        if kind == DUP:
            done.append(before)
        else:
            done.append(_name(held, before))
        out += b"".join(done[-1]) + b"\0"
    return bytes(out)


def _name(held: _Tokens, before: list[bytes]) -> list[bytes]:
    tokens: list[bytes] = [b""]
    while True:
        at = len(tokens)
        kind = held.byte(at, TYPE)
        if kind == CHAR:
            token = bytes([held.byte(at, CHAR)])
        elif kind == ALPHA:
            token = held.text(at)
        elif kind == DIGITS0:
            value = held.word(at, DIGITS0)
            token = str(value).zfill(held.byte(at, DZLEN)).encode()
        elif kind == DIGITS:
            token = str(held.word(at, DIGITS)).encode()
        elif kind in (DELTA, DELTA0):
            value = int(before[at]) + held.byte(at, kind)
            token = str(value).encode() if kind == DELTA else str(value).zfill(len(before[at])).encode()
        elif kind == MATCH:
            token = before[at]
        else:
            token = b""
        tokens.append(token)
        if kind == END:
            return tokens


_SPLIT = re.compile(rb"[0-9]{1,9}|[^0-9\0]+|[0-9]")


def names_encode(names: list[bytes]) -> bytes:
    """Names by tokens, each compared with the one before; repeated names are references to it."""
    streams: list[dict[int, bytearray]] = []

    def put(at: int, kind: int, *more: tuple[int, bytes]) -> None:
        while len(streams) <= at:
            streams.append({})
        streams[at].setdefault(TYPE, bytearray()).append(kind)
        for k, raw in more:
            streams[at].setdefault(k, bytearray()).extend(raw)

    before: list[bytes] = []
    for i, name in enumerate(names):
        if i and name == names[i - 1]:
            put(0, DUP, (DUP, struct.pack("<I", 1)))
            continue
        put(0, DIFF, (DIFF, struct.pack("<I", 1 if i else 0)))
        tokens = [b"", *_SPLIT.findall(name)]
        for at, token in enumerate(tokens[1:], 1):
            old = before[at] if at < len(before) else None
            if token == old:
                put(at, MATCH)
            elif not token.isdigit():
                put(at, ALPHA, (ALPHA, token + b"\0"))
            elif token[:1] == b"0":
                put(at, DIGITS0, (DIGITS0, struct.pack("<I", int(token))), (DZLEN, bytes([len(token)])))
            elif old is not None and old.isdigit() and old[:1] != b"0" and 0 <= int(token) - int(old) < 256:
                put(at, DELTA, (DELTA, bytes([int(token) - int(old)])))
            else:
                put(at, DIGITS, (DIGITS, struct.pack("<I", int(token))))
        put(len(tokens), END)
        before = [*tokens, b""]
    out = bytearray(struct.pack("<IIB", sum(len(n) + 1 for n in names), len(names), 0))
    for kinds in streams:
        for j, kind in enumerate(sorted(kinds)):
            body = nx16_encode(bytes(kinds[kind]))
            out += bytes([kind | (0x80 if j == 0 else 0)]) + vlq(len(body)) + body
    return bytes(out)


# quality scores -----------------------------------------------------------------------------

_MULTI, _SELECT_TABLE, _REVERSE = 1, 2, 4
_DEDUP, _FIXED_LENGTH, _SELECT, _MAP, _POSITIONS, _DELTAS, _SCORES = 2, 4, 8, 16, 32, 64, 128


def _run_table(b: Bytes, n: int) -> list[int]:
    """A rising table of ``n`` entries, stored as the lengths of its runs, themselves run-length coded."""
    runs, total, last = [], 0, -1
    while total < n:
        run = b.u8()
        copies = 1 + (b.u8() if run == last else 0)
        runs += [run] * copies
        total += run * copies
        last = run
    out: list[int] = []
    value, at = 0, 0
    while len(out) < n:
        length = 0
        while True:
            part = runs[at]
            at += 1
            length += part
            if part != 255:
                break
        out += [value] * length
        value += 1
    return out[:n]


class _Parameters:
    def __init__(self, b: Bytes) -> None:
        (self.context,) = b.unpack("H")
        self.flags, self.symbols = b.u8(), b.u8()
        x, y, z = b.u8(), b.u8(), b.u8()
        self.bits, self.shift, self.score_at, self.select_at, self.position_at, self.delta_at = x >> 4, x & 15, y >> 4, y & 15, z >> 4, z & 15
        self.map = [b.u8() for _ in range(self.symbols)] if self.flags & _MAP else None
        self.scores = _run_table(b, 256) if self.flags & _SCORES else list(range(256))
        self.positions = _run_table(b, 1024) if self.flags & _POSITIONS else None
        self.deltas = _run_table(b, 256) if self.flags & _DELTAS else None


def scores_decode(raw: bytes) -> bytes:
    """Quality scores of successive records."""
    b = Bytes(raw)
    n = b.vlq()
    if b.u8() != 5:
        raise ValueError("unknown version of the score codec")
    flags = b.u8()
    count = b.u8() if flags & _MULTI else 1
    top = count - 1
    table = list(range(count)) + [count - 1] * (256 - count)
    if flags & _SELECT_TABLE:
        top = b.u8()
        table = _run_table(b, 256)
    parameters = [_Parameters(b) for _ in range(count)]
    width = max(p.symbols for p in parameters) + 1
    c = RangeDecoder(b)
    contexts: dict[int, _Model] = {}
    lengths, repeated, turned, selector = [_Model(256) for _ in range(4)], _Model(2), _Model(2), _Model(top + 1)
    out = bytearray()
    reversed_: list[tuple[bool, int]] = []
    length, first = 0, True
    while len(out) < n:
        s = selector.decode(c) if top > 0 else 0
        p = parameters[table[s]]
        if first or not p.flags & _FIXED_LENGTH:
            length = sum(m.decode(c) << 8 * i for i, m in enumerate(lengths))
        first = False
        if flags & _REVERSE:
            reversed_.append((bool(turned.decode(c)), length))
        if p.flags & _DEDUP and repeated.decode(c):
            out += out[len(out) - length :]
            continue
        context, mixed, delta, last = p.context, 0, 0, 0
        for left in range(length, 0, -1):
            model = contexts.get(context)
            if model is None:
                model = contexts[context] = _Model(width)
            q = model.decode(c)
            out.append(p.map[q] if p.map else q)
            mixed = (mixed << p.shift) + p.scores[q]
            context = p.context + ((mixed & ((1 << p.bits) - 1)) << p.score_at)
            if p.positions:
                context += p.positions[min(left, 1023)] << p.position_at
            if p.deltas:
                context += p.deltas[min(delta, 255)] << p.delta_at
                delta += last != q
                last = q
            if p.flags & _SELECT:
                context += s << p.select_at
            context &= 0xFFFF
            mixed &= 0xFFFFFFFF
    if reversed_:
        at = 0
        for turn, size in reversed_:
            if turn:
                out[at : at + size] = out[at : at + size][::-1]
            at += size
    return bytes(out[:n])
