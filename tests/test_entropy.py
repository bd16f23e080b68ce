import random

import pytest

from strandline.sources import entropy as E

SAMPLES = [b"", b"a", b"abracadabra" * 3, bytes(range(256)) * 3, b"\0" * 1000, bytes(random.Random(1).choices(b"ACGTN", [5, 3, 3, 5, 1], k=5000)), b"I" * 50 + b"ABCDEFGH" * 20, bytes(random.Random(2).randrange(256) for _ in range(3000))]


@pytest.mark.parametrize("data", SAMPLES)
def test_coders_roundtrip(data):
    assert E.rans4_decode(E.rans4_encode(data)) == data
    assert E.nx16_decode(E.nx16_encode(data)) == data
    for order in (0, 1):
        assert E.range_decode(E.range_encode(data, order)) == data
    for method in (E.RAW, E.GZIP, E.BZIP2, E.LZMA, E.RANS4, E.RANS16, E.RANGE):
        assert E.decompress(method, E.compress(method, data), len(data)) == data


def test_integers():
    for v in (0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1, -1, -2, -(2**31)):
        assert E.Bytes(E.itf8(v)).itf8() == v
    for v in (0, 127, 128, 2**14, 2**21, 2**35, 2**49, 2**56 - 1, 2**56, 2**62, -1, -(2**63)):
        assert E.Bytes(E.ltf8(v)).ltf8() == v
    for v in (0, 127, 128, 2**20, 2**31):
        assert E.Bytes(E.vlq(v)).vlq() == v


def test_packing_and_runs():
    assert E._unpacked(bytes([0b10]), [65, 66], 2) == b"AB" and E._unpacked(b"", [65], 3) == b"AAA" and E._unpacked(bytes([0x21]), list(range(65, 75)), 2) == b"BC"
    packed = bytes([E._PACK | E._CAT]) + E.vlq(3) + bytes([2, 65, 66]) + E.vlq(1) + bytes([0b010])
    assert E.nx16_decode(packed) == b"ABA" == E.range_decode(packed)
    runs = bytes([1, 65]) + E.vlq(3)
    assert E.nx16_decode(bytes([E._RLE | E._CAT]) + E.vlq(5) + E.vlq(len(runs) << 1 | 1) + E.vlq(2) + runs + b"AB") == b"AAAAB"
    striped = bytes([E._STRIPE]) + E.vlq(4) + bytes([2]) + E.vlq(4) + E.vlq(4) + bytes([E._CAT]) + E.vlq(2) + b"AC" + bytes([E._CAT]) + E.vlq(2) + b"BD"
    assert E.nx16_decode(striped) == b"ABCD"
    with pytest.raises(ValueError):
        E.decompress(E.RAW, b"ab", 3)
