import hashlib
import os

import pytest

from strandline.sources import alignments, bam, cram, entropy, sequences
from strandline.sources.entropy import itf8
from strandline.sources.headers import SamHeader
from tests.test_formats import SAM, rows

HEADER = SamHeader.parse(SAM + "@RG\tID:g1\n")


def plain(rs):
    out = []
    for r in rs:
        tags = r[11].items() if isinstance(r[11], dict) else r[11]
        out.append((*tuple(r)[:11], sorted((t, tuple(sorted((k, str(v)) for k, v in (x.asDict() if hasattr(x, "asDict") else x).items()))) for t, x in tags)))
    return sorted(out, key=str)


@pytest.mark.parametrize("method", [entropy.GZIP, entropy.RANS4, entropy.RANS16, entropy.LZMA])
def test_file_roundtrip(tmp_path, method):
    data = rows(150)
    data += [("u", 4, None, None, None, None, None, None, 0, "ACGT", "IIII", {"RG": bam._value("Z", s="g1")}), ("n", 0, "sq1", 9, 3, "2H3S4M2I1D2N2P5M1H", None, None, 0, None, None, {}), ("x", 0, "sq1", 9, 3, "3S4M2I1D2N5M", "sq0", 5, 9, "ACGTNACGTACGTA", None, {})]
    p = str(tmp_path / "a.cram")
    with open(p, "wb") as f:
        cram.write_to(f, iter(data), HEADER, method=method)
    reader = cram._Reader({"path": p})
    got = [tuple(r.values()) for piece in reader.partitions() for b in reader.read(piece) for r in b.to_pylist()]
    assert plain(got) == plain(data) and alignments.format_of(p) == "cram"


def test_source_regions_and_index(spark, tmp_path):
    data = rows(400)
    cram.SLICE_RECORDS, held = 50, cram.SLICE_RECORDS
    try:
        with open(tmp_path / "a.cram", "wb") as f:
            cram.write_to(f, iter(data), HEADER)
    finally:
        cram.SLICE_RECORDS = held
    p = str(tmp_path / "a.cram")
    assert len(cram._Reader({"path": p, "task_bytes": "1"}).partitions()) == 9 > len(cram._Reader({"path": p, "task_bytes": "1", "region": "sq1:1-20000"}).partitions())
    df = alignments.read_alignments(spark, p)
    assert df.count() == len(data)
    span = {"36M": 36, "10M50N26M": 86}
    near = sorted(r[0] for r in data if r[2] == "sq1" and r[3] <= 20000 and r[3] + span[r[5]] - 1 >= 1000)
    assert sorted(r["name"] for r in alignments.read_alignments(spark, p, region="sq1:1000-20000").collect()) == near
    index = cram.build_crai(p)
    cram.write_crai(p)
    assert len(cram._Reader({"path": p, "task_bytes": "1", "region": "sq1:1-20000"}).partitions()) < 9
    assert sorted(r["name"] for r in alignments.read_alignments(spark, p, region="sq1:1000-20000").collect()) == near
    os.rename(cram.write_crai(p), tmp_path / "a.crai.gz")
    assert sequences.read_crai(spark, str(tmp_path / "a.crai.gz")).count() == len(index)
    assert {r[0] for r in index} == {0, 1, -1} and sum(r[0] == 1 for r in index) == 9
    alignments.write_alignments(df.repartition(2), str(tmp_path / "o.cram"), HEADER)
    assert alignments.read_alignments(spark, str(tmp_path / "o.cram")).count() == len(data)


def _reference_file(path, reference, md5, embedded=False):
    """A file of one slice with two mates that needs a reference: substitutions, deletions and a mate chain."""
    ids = {"BF": 1, "CF": 2, "RL": 3, "AP": 4, "RG": 5, "RN": 6, "NF": 7, "TL": 8, "FN": 9, "FC": 10, "FP": 11, "BS": 12, "DL": 13, "MQ": 14}
    external = lambda i: itf8(1) + itf8(len(itf8(i))) + itf8(i)
    stop = lambda i: itf8(5) + itf8(2) + b"\0" + itf8(i)
    keep = itf8(5) + b"RN\1" + b"AP\1" + b"RR\1" + b"SM" + bytes([0x1B] * 5) + b"TD" + itf8(1) + b"\0"
    series = itf8(len(ids)) + b"".join(k.encode() + (stop(i) if k == "RN" else external(i)) for k, i in ids.items())
    head = b"".join(itf8(len(x)) + x for x in (keep, series, itf8(0)))
    data = {"BF": itf8(67) + itf8(147), "CF": itf8(4) + itf8(0), "RL": itf8(4) * 2, "AP": itf8(0) + itf8(5), "RG": itf8(-1) * 2, "RN": b"p\0p\0", "NF": itf8(0), "TL": itf8(0) * 2, "FN": itf8(1) * 2, "FC": b"XD", "FP": itf8(2) + itf8(3), "BS": bytes([1]), "DL": itf8(2), "MQ": itf8(9) * 2}
    blocks = [cram._pack_block(cram.CORE, 0, b"", 0), *(cram._pack_block(cram.EXTERNAL, ids[k], v, 0) for k, v in data.items())]
    if embedded:
        blocks.append(cram._pack_block(cram.EXTERNAL, 99, reference.encode(), 0))
    slice_ = itf8(0) + itf8(1) + itf8(len(reference)) + itf8(2) + itf8(0) + itf8(len(blocks)) + itf8(len(data)) + b"".join(itf8(ids[k]) for k in data) + itf8(99 if embedded else -1) + md5
    first = cram._pack_block(cram.COMPRESSION, 0, head, 0)
    text = b"@SQ\tSN:sq0\tLN:12\n"
    with open(path, "wb") as f:
        f.write(b"CRAM\3\0" + bytes(20))
        f.write(cram._pack_container(0, 0, 0, 0, 0, 0, [cram._pack_block(cram.HEADER, 0, len(text).to_bytes(4, "little") + text, 0)], [0]))
        f.write(cram._pack_container(0, 1, len(reference), 2, 0, 8, [first, cram._pack_block(cram.SLICE, 0, slice_, 0), *blocks], [len(first)]))
        f.write(cram.EOF)


@pytest.mark.parametrize("embedded", [False, True])
def test_reference_substitutions_and_mates(tmp_path, embedded):
    reference = "ACGTACGTACGT"
    (tmp_path / "r.fa").write_text(">sq0\nACGTAC\nGTACGT\n")
    p = str(tmp_path / "a.cram")
    _reference_file(p, reference, hashlib.md5(reference.encode()).digest(), embedded)
    reader = cram._Reader({"path": p, "reference": "" if embedded else str(tmp_path / "r.fa")})
    a, b = [tuple(r.values()) for piece in reader.partitions() for x in reader.read(piece) for r in x.to_pylist()]
    # code 1 of reference base C is its second other base, G
    assert a[:11] == ("p", 67 | 0x20, "sq0", 1, 9, "4M", "sq0", 6, 11, "AGGT", None)
    assert b[:11] == ("p", 147, "sq0", 6, 9, "2M2D2M", "sq0", 1, -11, "CGCG", None)
    if not embedded:
        (tmp_path / "r.fa").write_text(">sq0\nACGTAC\nGTACGA\n")
        with pytest.raises(ValueError, match="checksum"):
            list(reader.read(reader.partitions()[0]))
        with pytest.raises(ValueError, match="needs a reference"):
            list(cram._Reader({"path": p}).read(reader.partitions()[0]))


def test_codes():
    bits = cram.Streams(cram.Bits(bytes([0b01011010, 0b00101000])), {})
    read = cram._huffman([5, 6, 7], [1, 2, 2])
    assert [read(bits) for _ in range(4)] == [5, 6, 7, 5]
    gamma = cram._integers(9, entropy.Bytes(itf8(1)))
    assert gamma(cram.Streams(cram.Bits(bytes([0b00101000])), {})) == 4
    beta = cram._integers(6, entropy.Bytes(itf8(-3) + itf8(4)))
    assert beta(cram.Streams(cram.Bits(bytes([0b01010000])), {})) == 8
    with pytest.raises(NotImplementedError):
        cram._integers(2, entropy.Bytes(b""))


def provider():
    return {"sq0": "acgt"}.get


def test_references_from_a_folder_or_a_provider(tmp_path):
    (tmp_path / "a.fa").write_text(">sq0\nACGT\nAC\n")
    (tmp_path / "b.fa").write_text(">sq1\nggtt\n")
    held = cram.References(str(tmp_path))
    assert held.get("sq1") == "GGTT" and held.get("sq0") == "ACGTAC"
    own = cram.References("python:tests.test_cram:provider")
    assert own.get("sq0") == "ACGT"
    for r in (held, own):
        with pytest.raises(ValueError, match="has no"):
            r.get("sq9")
    with pytest.raises(ValueError, match="needs a reference"):
        cram.References(None).get("sq0")
