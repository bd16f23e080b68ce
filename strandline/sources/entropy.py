"""Entropy coders of compressed alignment blocks: rANS 4x8, rANS Nx16 and the adaptive range coder."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib

BITS4, LOW4 = 12, 1 << 23
BITS16, LOW16 = 12, 1 << 15


class Bytes:
    """A cursor over bytes with the variable-length integers of the format."""

    def __init__(self, raw: bytes, at: int = 0) -> None:
        self.raw, self.at = raw, at

    def u8(self) -> int:
        v = self.raw[self.at]
        self.at += 1
        return v

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("truncated data")
        self.at += n
        return out

    def unpack(self, fmt: str) -> tuple:
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))

    def itf8(self) -> int:
        """Up to 32 bits: the leading ones of the first byte count the bytes that follow."""
        a = self.u8()
        if a < 0x80:
            return a
        if a < 0xC0:
            return (a & 0x3F) << 8 | self.u8()
        if a < 0xE0:
            b = self.take(2)
            return (a & 0x1F) << 16 | b[0] << 8 | b[1]
        if a < 0xF0:
            b = self.take(3)
            return (a & 0x0F) << 24 | b[0] << 16 | b[1] << 8 | b[2]
        b = self.take(4)
        v = (a & 0x0F) << 28 | b[0] << 20 | b[1] << 12 | b[2] << 4 | b[3] & 0x0F
        return v - (1 << 32) if v >> 31 else v

    def ltf8(self) -> int:
        """Up to 64 bits, in the same manner."""
        a, extra = self.u8(), 0
        while extra < 8 and a & (0x80 >> extra):
            extra += 1
        v = a & (0xFF >> (extra + 1)) if extra < 7 else 0
        for b in self.take(extra):
            v = v << 8 | b
        return v - (1 << 64) if v >> 63 else v

    def vlq(self) -> int:
        """Seven bits a byte, the highest first."""
        v = 0
        while True:
            b = self.u8()
            v = v << 7 | b & 0x7F
            if b < 0x80:
                return v


def itf8(v: int) -> bytes:
    v &= 0xFFFFFFFF
    if v < 1 << 7:
        return bytes([v])
    if v < 1 << 14:
        return struct.pack(">H", v | 0x8000)
    if v < 1 << 21:
        return struct.pack(">I", v | 0xC00000)[1:]
    if v < 1 << 28:
        return struct.pack(">I", v | 0xE0000000)
    return bytes([0xF0 | v >> 28, v >> 20 & 255, v >> 12 & 255, v >> 4 & 255, v & 15])


def ltf8(v: int) -> bytes:
    v &= (1 << 64) - 1
    for extra in range(8):
        if v < 1 << (7 * (extra + 1)):
            lead = (0xFF00 >> extra) & 0xFF
            raw = v.to_bytes(extra + 1, "big")
            return bytes([raw[0] | lead]) + raw[1:]
    return b"\xff" + v.to_bytes(8, "big")


def vlq(v: int) -> bytes:
    out = [v & 0x7F]
    while v := v >> 7:
        out.append(v & 0x7F | 0x80)
    return bytes(reversed(out))


# rANS 4x8 -----------------------------------------------------------------------------------


def _symbols(b: Bytes, each) -> None:
    """Walk a run-length coded list of symbols that ends with 0; ``each`` reads what belongs to one."""
    sym, run = b.u8(), 0
    while True:
        each(sym)
        if run:
            run -= 1
            sym += 1
        else:
            last, sym = sym, b.u8()
            if sym == last + 1:
                run = b.u8()
        if sym == 0:
            return


def _table4(b: Bytes) -> list[int]:
    freq = [0] * 256

    def one(s: int) -> None:
        f = b.u8()
        freq[s] = (f & 0x7F) << 8 | b.u8() if f >= 0x80 else f

    _symbols(b, one)
    return freq


def _lookup(freq: list[int], bits: int) -> tuple[list[int], bytearray]:
    starts, at, slots = [0] * 256, 0, bytearray(1 << bits)
    for s, f in enumerate(freq):
        starts[s] = at
        if f:
            slots[at : at + f] = bytes([s]) * f
            at += f
    return starts, slots


def rans4_decode(raw: bytes) -> bytes:
    b = Bytes(raw)
    order = b.u8()
    _, n = b.unpack("II")
    if n == 0:
        return b""
    mask = (1 << BITS4) - 1
    if order == 0:
        freq = _table4(b)
        starts, slots = _lookup(freq, BITS4)
        states = list(b.unpack("4I"))
        data, at, out = raw, b.at, bytearray(n)
        for i in range(n):
            r = states[i & 3]
            slot = r & mask
            s = slots[slot]
            out[i] = s
            r = freq[s] * (r >> BITS4) + slot - starts[s]
            while r < LOW4:
                r = r << 8 | data[at]
                at += 1
            states[i & 3] = r
        return bytes(out)
    tables: dict[int, tuple] = {}

    def context(s: int) -> None:
        f = _table4(b)
        tables[s] = (f, *_lookup(f, BITS4))

    _symbols(b, context)
    states = list(b.unpack("4I"))
    data, at, out = raw, b.at, bytearray(n)
    quarter, last = n // 4, [0] * 4
    ends = [quarter, 2 * quarter, 3 * quarter, n]
    spots = [0, quarter, 2 * quarter, 3 * quarter]
    while spots[3] < n:
        for j in range(4):
            if spots[j] >= ends[j]:
                continue
            freq, starts, slots = tables[last[j]]
            r = states[j]
            slot = r & mask
            s = slots[slot]
            out[spots[j]] = s
            spots[j] += 1
            last[j] = s
            r = freq[s] * (r >> BITS4) + slot - starts[s]
            while r < LOW4:
                r = r << 8 | data[at]
                at += 1
            states[j] = r
    return bytes(out)


def _scaled(counts: list[int], total: int) -> list[int]:
    """Frequencies in proportion to counts that add up to ``total``, each at least 1 where the count is."""
    n = sum(counts)
    freq = [max(1, c * total // n) if c else 0 for c in counts]
    while (over := sum(freq) - total) != 0:
        s = max(range(256), key=lambda s: freq[s])
        step = -min(over, freq[s] - 1) if over > 0 else -over
        freq[s] += step
    return freq


def _write_symbols(present: list[int], each) -> bytes:
    """The run-length coded list of symbols, with what ``each`` writes for one after it."""
    out, i = bytearray(), 0
    while i < len(present):
        s = present[i]
        out.append(s)
        if i and present[i - 1] == s - 1:
            run = 0
            while i + run + 1 < len(present) and present[i + run + 1] == s + run + 1:
                run += 1
            out.append(run)
            for k in range(run + 1):
                out += each(s + k)
            i += run + 1
        else:
            out += each(s)
            i += 1
    out.append(0)
    return bytes(out)


def _frequency4(f: int) -> bytes:
    return bytes([f]) if f < 0x80 else bytes([0x80 | f >> 8, f & 0xFF])


def rans4_encode(data: bytes) -> bytes:
    """Order 0."""
    if not data:
        return struct.pack("<BII", 0, 0, 0)
    counts = [0] * 256
    for c in data:
        counts[c] += 1
    freq = _scaled(counts, (1 << BITS4) - 1)
    starts, _ = _lookup(freq, BITS4)
    table = _write_symbols([s for s in range(256) if freq[s]], lambda s: _frequency4(freq[s]))
    states, out = [LOW4] * 4, bytearray()
    for i in range(len(data) - 1, -1, -1):
        s, r = data[i], states[i & 3]
        limit = (LOW4 >> BITS4 << 8) * freq[s]
        while r >= limit:
            out.append(r & 0xFF)
            r >>= 8
        states[i & 3] = (r // freq[s] << BITS4) + r % freq[s] + starts[s]
    body = table + struct.pack("<4I", *states) + bytes(reversed(out))
    return struct.pack("<BII", 0, len(body), len(data)) + body


# rANS Nx16 ----------------------------------------------------------------------------------

_ORDER, _X32, _STRIPE, _NO_SIZE, _CAT, _RLE, _PACK = 1, 4, 8, 16, 32, 64, 128


def _alphabet(b: Bytes) -> list[int]:
    found: list[int] = []
    _symbols(b, found.append)
    return found


def _normalised(freq: list[int], bits: int) -> list[int]:
    total = sum(freq)
    shift = 0
    while 0 < total << shift < 1 << bits:
        shift += 1
    return [f << shift for f in freq]


def _table16(b: Bytes) -> list[int]:
    freq = [0] * 256
    for s in _alphabet(b):
        freq[s] = b.vlq()
    return _normalised(freq, BITS16)


def _renorm16(r: int, data: bytes, at: int) -> tuple[int, int]:
    if r < LOW16 and at + 1 < len(data):
        return r << 16 | data[at] | data[at + 1] << 8, at + 2
    return r, at


def _nx16_order0(b: Bytes, n: int, ways: int) -> bytes:
    freq = _table16(b)
    starts, slots = _lookup(freq, BITS16)
    states = list(b.unpack(f"{ways}I"))
    data, at, out, mask = b.raw, b.at, bytearray(n), (1 << BITS16) - 1
    for i in range(n):
        r = states[i % ways]
        slot = r & mask
        s = slots[slot]
        out[i] = s
        states[i % ways], at = _renorm16(freq[s] * (r >> BITS16) + slot - starts[s], data, at)
    b.at = at
    return bytes(out)


def _nx16_order1(b: Bytes, n: int, ways: int) -> bytes:
    head = b.u8()
    bits = head >> 4
    t = b
    if head & 1:
        size, packed = b.vlq(), b.vlq()
        t = Bytes(_nx16_order0(Bytes(b.take(packed)), size, 4))
    alphabet = _alphabet(t)
    tables: dict[int, tuple] = {}
    for context in alphabet:
        freq, run = [0] * 256, 0
        for s in alphabet:
            if run:
                run -= 1
                continue
            f = t.vlq()
            freq[s] = f
            if f == 0:
                run = t.u8()
        freq = _normalised(freq, bits)
        tables[context] = (freq, *_lookup(freq, bits))
    states = list(b.unpack(f"{ways}I"))
    data, at, out, mask = b.raw, b.at, bytearray(n), (1 << bits) - 1
    part = n // ways
    spots = [j * part for j in range(ways)]
    ends = [(j + 1) * part for j in range(ways - 1)] + [n]
    last = [0] * ways
    for _ in range(n - part * (ways - 1)):
        for j in range(ways):
            if spots[j] >= ends[j]:
                continue
            freq, starts, slots = tables[last[j]]
            r = states[j]
            slot = r & mask
            s = slots[slot]
            out[spots[j]] = last[j] = s
            spots[j] += 1
            states[j], at = _renorm16(freq[s] * (r >> bits) + slot - starts[s], data, at)
    b.at = at
    return bytes(out)


def _unpacked(data: bytes, symbols: list[int], n: int) -> bytes:
    """Bytes from packed symbols: 1, 2 or 4 bits each, or none where there is one symbol."""
    if len(symbols) <= 1:
        return bytes(symbols or [0]) * n
    bits = 1 if len(symbols) <= 2 else 2 if len(symbols) <= 4 else 4
    per, mask, out = 8 // bits, (1 << bits) - 1, bytearray()
    for v in data:
        for _ in range(per):
            out.append(symbols[v & mask])
            v >>= bits
    return bytes(out[:n])


def _unrolled(data: bytes, runs: Bytes, symbols: set[int], n: int) -> bytes:
    out = bytearray()
    for s in data:
        out += bytes([s]) * (1 + runs.vlq()) if s in symbols else bytes([s])
    return bytes(out[:n])


def _striped(b: Bytes, n: int, decode) -> bytes:
    ways = b.u8()
    sizes = [b.vlq() for _ in range(ways)]
    out = bytearray(n)
    for j, size in enumerate(sizes):
        out[j::ways] = decode(b.take(size), (n - j + ways - 1) // ways)
    return bytes(out)


def nx16_decode(raw: bytes, size: int | None = None) -> bytes:
    b = Bytes(raw)
    flags = b.u8()
    n = size if flags & _NO_SIZE else b.vlq()
    ways = 32 if flags & _X32 else 4
    if flags & _STRIPE:
        return _striped(b, n, nx16_decode)
    whole, symbols, runs, rle = n, [], None, set()
    if flags & _PACK:
        symbols = [b.u8() for _ in range(b.u8())]
        n = b.vlq()
    unrolled = n
    if flags & _RLE:
        head, n = b.vlq(), b.vlq()
        meta = b.take(head >> 1) if head & 1 else _nx16_order0(Bytes(b.take(b.vlq())), head >> 1, ways)
        runs = Bytes(meta)
        count = runs.u8() or 256
        rle = {runs.u8() for _ in range(count)}
    if flags & _CAT:
        data = b.take(n)
    elif n == 0:
        data = b""
    else:
        data = _nx16_order1(b, n, ways) if flags & _ORDER else _nx16_order0(b, n, ways)
    if flags & _RLE:
        data = _unrolled(data, runs, rle, unrolled)
    return _unpacked(data, symbols, whole) if flags & _PACK else data


def nx16_encode(data: bytes) -> bytes:
    """Order 0 with four states; short data is stored."""
    if len(data) < 16:
        return bytes([_CAT]) + vlq(len(data)) + data
    counts = [0] * 256
    for c in data:
        counts[c] += 1
    freq = _scaled(counts, 1 << BITS16)
    starts, _ = _lookup(freq, BITS16)
    present = [s for s in range(256) if freq[s]]
    states, out = [LOW16] * 4, bytearray()
    for i in range(len(data) - 1, -1, -1):
        s, r = data[i], states[i & 3]
        if r >= (LOW16 >> BITS16 << 16) * freq[s]:
            out += bytes([r >> 8 & 0xFF, r & 0xFF])
            r >>= 16
        states[i & 3] = (r // freq[s] << BITS16) + r % freq[s] + starts[s]
    table = _write_symbols(present, lambda s: b"") + b"".join(vlq(freq[s]) for s in present)
    return bytes([0]) + vlq(len(data)) + table + struct.pack("<4I", *states) + bytes(reversed(out))


# adaptive range coder -----------------------------------------------------------------------


class _Model:
    """Adaptive frequencies of ``n`` symbols, kept roughly sorted."""

    STEP, LIMIT = 16, (1 << 16) - 17

    def __init__(self, n: int) -> None:
        self.symbols, self.freq, self.total = list(range(n)), [1] * n, n

    def update(self, i: int) -> None:
        self.freq[i] += self.STEP
        self.total += self.STEP
        if self.total > self.LIMIT:
            self.freq = [f - (f >> 1) for f in self.freq]
            self.total = sum(self.freq)
        if i and self.freq[i] > self.freq[i - 1]:
            for xs in (self.freq, self.symbols):
                xs[i], xs[i - 1] = xs[i - 1], xs[i]

    def decode(self, c: RangeDecoder) -> int:
        target, low, i = c.position(self.total), 0, 0
        while low + self.freq[i] <= target:
            low += self.freq[i]
            i += 1
        c.narrow(low, self.freq[i])
        s = self.symbols[i]
        self.update(i)
        return s

    def encode(self, c: RangeEncoder, s: int) -> None:
        i = self.symbols.index(s)
        c.narrow(sum(self.freq[:i]), self.freq[i], self.total)
        self.update(i)


class RangeDecoder:
    def __init__(self, b: Bytes) -> None:
        self.b, self.range, self.code = b, 0xFFFFFFFF, 0
        b.u8()
        for _ in range(4):
            self.code = self.code << 8 | b.u8()

    def position(self, total: int) -> int:
        self.range //= total
        return self.code // self.range

    def narrow(self, low: int, freq: int) -> None:
        self.code -= low * self.range
        self.range *= freq
        while self.range < 1 << 24:
            self.range <<= 8
            self.code = (self.code << 8 | (self.b.u8() if self.b.at < len(self.b.raw) else 0)) & 0xFFFFFFFF


class RangeEncoder:
    def __init__(self) -> None:
        self.low, self.range, self.cache, self.waiting, self.carry, self.out = 0, 0xFFFFFFFF, 0, 0, 0, bytearray()

    def narrow(self, low: int, freq: int, total: int) -> None:
        self.range //= total
        self.low += low * self.range
        if self.low > 0xFFFFFFFF:
            self.low &= 0xFFFFFFFF
            self.carry = 1
        self.range *= freq
        while self.range < 1 << 24:
            self.range <<= 8
            self._shift()

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.carry:
            self.out.append(self.cache + self.carry & 0xFF)
            self.out += bytes([0xFF + self.carry & 0xFF]) * self.waiting
            self.waiting, self.cache, self.carry = 0, self.low >> 24, 0
        else:
            self.waiting += 1
        self.low = self.low << 8 & 0xFFFFFFFF

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


def _range_plain(b: Bytes, n: int, order: int) -> bytes:
    top = b.u8() or 256
    c = RangeDecoder(b)
    models = [_Model(top) for _ in range(top if order else 1)]
    out, last = bytearray(n), 0
    for i in range(n):
        last_model = models[last if order else 0]
        out[i] = last = last_model.decode(c)
    return bytes(out)


def _range_rle(b: Bytes, n: int, order: int) -> bytes:
    top = b.u8() or 256
    c = RangeDecoder(b)
    models, runs = [_Model(top) for _ in range(top if order else 1)], [_Model(4) for _ in range(258)]
    out, last = bytearray(), 0
    while len(out) < n:
        s = models[last if order else 0].decode(c)
        last, run, at = s, 0, s
        while True:
            part = runs[at].decode(c)
            run += part
            at = 256 if at < 256 else 257
            if part != 3 or run >= n:
                break
        out += bytes([s]) * (run + 1)
    return bytes(out[:n])


_EXTERNAL = 4


def range_decode(raw: bytes, size: int | None = None) -> bytes:
    b = Bytes(raw)
    flags = b.u8()
    n = size if flags & _NO_SIZE else b.vlq()
    if flags & _STRIPE:
        return _striped(b, n, range_decode)
    whole, symbols = n, []
    if flags & _PACK:
        symbols = [b.u8() for _ in range(b.u8())]
        n = b.vlq()
    if flags & _CAT:
        data = b.take(n)
    elif flags & _EXTERNAL:
        data = bz2.decompress(raw[b.at :])
    elif n == 0:
        data = b""
    else:
        data = (_range_rle if flags & _RLE else _range_plain)(b, n, flags & _ORDER)
    return _unpacked(data, symbols, whole) if flags & _PACK else data


def range_encode(data: bytes, order: int = 0) -> bytes:
    if not data:
        return bytes([_CAT]) + vlq(0)
    top = max(data) + 1
    c, models, last = RangeEncoder(), [_Model(top) for _ in range(top if order else 1)], 0
    for s in data:
        models[last if order else 0].encode(c, s)
        last = s
    return bytes([order]) + vlq(len(data)) + bytes([top & 0xFF]) + c.finish()


# block methods ------------------------------------------------------------------------------

RAW, GZIP, BZIP2, LZMA, RANS4, RANS16, RANGE, QUALITIES, NAMES = range(9)


def decompress(method: int, data: bytes, size: int) -> bytes:
    """The data of a block of ``size`` bytes."""
    if method == RAW:
        out = data
    elif method == GZIP:
        out = gzip.decompress(data)
    elif method == BZIP2:
        out = bz2.decompress(data)
    elif method == LZMA:
        out = lzma.decompress(data)
    elif method == RANS4:
        out = rans4_decode(data)
    elif method == RANS16:
        out = nx16_decode(data)
    elif method == RANGE:
        out = range_decode(data)
    elif method in (QUALITIES, NAMES):
        from strandline.sources import record_codecs

        out = record_codecs.scores_decode(data) if method == QUALITIES else record_codecs.names_decode(data)
    else:
        raise ValueError(f"invalid block method {method}")
    if len(out) != size:
        raise ValueError("a block has another size than it says")
    return out


def compress(method: int, data: bytes) -> bytes:
    encoders = {RAW: bytes, GZIP: lambda d: zlib.compress(d, wbits=31), BZIP2: bz2.compress, LZMA: lzma.compress, RANS4: rans4_encode, RANS16: nx16_encode, RANGE: range_encode}
    return encoders[method](data)
