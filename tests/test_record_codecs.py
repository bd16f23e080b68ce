import random

import pytest

from strandline.sources import entropy, record_codecs
from strandline.sources.entropy import RangeEncoder, _Model, vlq


@pytest.mark.parametrize("names", [[b"a"], [b"I17_08765:2:123:61541:01763#9", b"I17_08765:2:123:1636:08611#9", b"I17_08765:2:124:45613:16161#9"], [b"r1", b"r1", b"r2", b"r300", b"r07", b"r08", b"x", b""], [f"q{i}:{i * 7}:00{i % 3}".encode() for i in range(500)]])
def test_names_roundtrip(names):
    raw = record_codecs.names_encode(names)
    want = b"".join(n + b"\0" for n in names)
    assert record_codecs.names_decode(raw) == want == entropy.decompress(entropy.NAMES, raw, len(want))


def test_published_scores():
    raw = bytes.fromhex("190500000020" "03827f0f01017dffff018400" "09fffff60165" "00862e98eaca716f22cdd840")
    want = bytes([0, 0, 0, 1, 1, 2, 1, 1, 0, 0, 0, 1, 2, 3, 3, 3, 3, 3, 3, 3, 2, 1, 1, 0, 0])
    assert record_codecs.scores_decode(raw) == want


def _encode(records, *, turned, repeats):
    """Scores of records of varying length in two contexts, some turned, some repeats of the record before."""
    flags = (record_codecs._REVERSE if turned else 0)
    head = bytes([5, flags]) + (7).to_bytes(2, "little") + bytes([record_codecs._DEDUP if repeats else 0, 40, 0x11, 0x00, 0x00])
    c, contexts = RangeEncoder(), {}
    lengths, again, turn = [_Model(256) for _ in range(4)], _Model(2), _Model(2)
    total, last = 0, None
    for r, back in records:
        for i, m in enumerate(lengths):
            m.encode(c, len(r) >> 8 * i & 255)
        if turned:
            turn.encode(c, int(back))
        text = r[::-1] if turned and back else r
        total += len(r)
        if repeats:
            again.encode(c, int(text == last))
            if text == last:
                continue
        last = text
        context = 7
        for q in text:
            contexts.setdefault(context, _Model(41)).encode(c, q)
            context = 7 + (q & 1)
    return vlq(total) + head + c.finish()


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("repeats", [False, True])
def test_scores_of_many_records(turned, repeats):
    rng = random.Random(3)
    records = []
    for _ in range(60):
        r = bytes(rng.randrange(40) for _ in range(rng.randint(1, 300)))
        records += [(r, rng.random() < 0.5)] * rng.choice([1, 2])
    assert record_codecs.scores_decode(_encode(records, turned=turned, repeats=repeats)) == b"".join(r for r, _ in records)
