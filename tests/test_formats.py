import io
import os
import random

import pytest

from strandline.sources import alignments, bam, bgzf, binning, text
from strandline.sources.headers import SamHeader, VcfHeader

SAM = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:sq0\tLN:8\n@SQ\tSN:sq1\tLN:200000\n"


def put(tmp_path, name, content):
    p = tmp_path / name
    (p.write_bytes if isinstance(content, bytes) else p.write_text)(content)
    return str(p)


def test_blocks_seek_and_index():
    data = os.urandom(200_000) + b"A" * 300_000
    f = io.BytesIO()
    w = bgzf.Writer(f)
    w.write(data)
    w.close()
    assert bgzf.has_eof(f) and bgzf.Reader(io.BytesIO(f.getvalue())).read() == data
    index = bgzf.parse_gzi(bgzf.gzi_bytes(w.index))
    for at in (0, 1, 65279, 65280, 250_000, len(data) - 1):
        r = bgzf.Reader(io.BytesIO(f.getvalue()))
        r.seek(bgzf.gzi_position(index, at))
        assert r.read(5) == data[at : at + 5]
    assert bgzf.read_at(io.BytesIO(f.getvalue()), index, 123_456, 1000) == data[123_456:124_456]
    assert len(list(bgzf.block_offsets(io.BytesIO(f.getvalue())))) == len(w.index) + 1
    broken = bytearray(f.getvalue())
    broken[-len(bgzf.EOF) - 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        bgzf.Reader(io.BytesIO(bytes(broken))).read()


def rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        pos = rng.randint(1, 190_000)
        seq = "".join(rng.choice("ACGT") for _ in range(36))
        tags = {"NH": bam._value("i", i=rng.choice([1, -5, 300, 70000])), "CO": bam._value("Z", s="a b"), "XB": bam._value("BS", ai=[1, 60000]), "XF": bam._value("f", f=0.5), "XA": bam._value("A", s="q")}
        out.append((f"r{i}", rng.choice([0, 16, 99]), "sq1", pos, rng.choice([None, 7]), rng.choice(["36M", "10M50N26M"]), rng.choice(["sq0", None, "sq1"]), rng.choice([None, 4]), -7, seq, "I" * 36, tags))
    out.sort(key=lambda r: r[3])
    return [("first", 0, "sq0", 1, None, "4M", None, None, 0, "ACGT", None, {}), *out, ("last", 4, None, None, None, None, None, None, 0, None, None, {})]


def test_bam_roundtrip_index_and_regions(spark, tmp_path):
    data, header = rows(6000), SamHeader.parse(SAM)
    bam.register(spark)
    out = str(tmp_path / "out")
    bam.write_bam(spark.createDataFrame(data, bam.SCHEMA).coalesce(1), out, header)
    (name,) = bam._files(out)
    assert bam.quickcheck(name) and alignments.format_of(out) == "bam"
    plain = lambda rs: sorted((r["name"], r["flags"], r["rname"], r["pos"], r["mapq"], r["cigar"], r["mate_rname"], r["mate_pos"], r["tlen"], r["seq"], r["qual"], str(sorted((k, v.asDict()) for k, v in r["tags"].items()))) for r in rs)
    want = plain(spark.createDataFrame(data, bam.SCHEMA).collect())
    assert plain(bam.read_bam(spark, out).collect()) == want
    for size in (20_000, 5_000, 977):
        reader = bam._Reader({"path": name, "task_bytes": str(size)})
        assert len(reader.partitions()) > 3
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()]
        assert got == [r[0] for r in data]
    for csi in (False, True):
        at = bam.write_index(name, csi=csi)
        index = bam.index_of(name)
        assert index.unplaced == 1 and index.references[1].metadata[2] == 6000
        for region, lo, hi in (("sq1:1000-2000", 1000, 2000), ("sq1:100000", 100000, 10**9), ("sq1", 1, 10**9)):
            span = {"36M": 36, "10M50N26M": 86}
            near = sorted(r[0] for r in data if r[2] == "sq1" and r[3] <= hi and r[3] + span[r[5]] - 1 >= lo)
            assert sorted(r["name"] for r in alignments.read_alignments(spark, out, region=region).collect()) == near
        os.remove(at)
    with pytest.raises(Exception, match="not in the dictionary"):
        bam.write_index(name)
        bam.read_bam(spark, out, region="nope:1-2").collect()


def test_index_of_two_records(tmp_path):
    f = io.BytesIO()
    w = bgzf.Writer(f)
    w.write(bam.header_bytes(SamHeader.parse("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:sq0\tLN:8\n")))
    for row in (("*", 0, "sq0", 1, None, None, None, None, 0, None, None, {}), ("*", 4, None, None, None, None, None, None, 0, None, None, {})):
        w.write(bam.encode(row, {"sq0": 0}))
    w.close()
    index = bam.build_index(io.BytesIO(f.getvalue()))
    assert list(index.references[0].bins) == [4681] and index.references[0].metadata[2:] == (1, 0) and index.unplaced == 1
    for parse, write in ((binning.parse_bai, binning.bai_bytes), (binning.parse_csi, binning.csi_bytes)):
        back = parse(write(index))
        assert back.references[0].bins == index.references[0].bins and back.references[0].metadata == index.references[0].metadata and back.unplaced == 1
    index.header = binning.preset("vcf", ["sq0"])
    assert binning.parse_tbi(binning.tbi_bytes(index)).header == index.header
    with pytest.raises(ValueError, match="sorted"):
        g = io.BytesIO()
        v = bgzf.Writer(g)
        v.write(bam.header_bytes(SamHeader.parse("@SQ\tSN:sq0\tLN:8\n")))
        v.close()
        bam.build_index(io.BytesIO(g.getvalue()))


def test_many_operations_overflow_into_a_tag():
    cigar = "1M1I" * 40000
    row = ("r", 0, "sq0", 1, None, cigar, None, None, 0, "A" * 80000, None, {})
    assert bam.decode(bam.encode(row, {"sq0": 0})[4:], ["sq0"])[5] == cigar


def test_concatenation_and_reheader(spark, tmp_path):
    header = SamHeader.parse(SAM)
    for n in ("a", "b"):
        bam.write_bam(spark.createDataFrame(rows(5), bam.SCHEMA).coalesce(1), str(tmp_path / n), header)
    out = str(tmp_path / "c.bam")
    bam.concatenate([bam._files(str(tmp_path / n))[0] for n in ("a", "b")], out)
    assert bam.read_bam(spark, out).count() == 14
    header.comments.append("new")
    bam.reheader(out, header, str(tmp_path / "d.bam"))
    with open(tmp_path / "d.bam", "rb") as f:
        assert bam.read_header(bgzf.Reader(f))[0].comments == ["new"]


def test_sam_text(spark, tmp_path):
    line = "*\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*\tNH:i:1\tCO:Z:ndls"
    other = "r1\t99\tsq0\t3\t60\t4M\t=\t7\t8\tACGT\tIIII"
    p = put(tmp_path, "a.sam", SAM + line + "\r\n" + other + "\n")
    got = sorted(text.read_sam(spark, p).collect(), key=lambda r: r["flags"])
    a, b = got
    assert (a["name"], a["flags"], a["rname"], a["pos"], a["mapq"], a["cigar"], a["seq"], a["qual"]) == (None, 4, None, None, None, None, None, None) and a["tags"]["NH"]["i"] == 1
    assert (b["mate_rname"], b["mate_pos"], b["tags"]) == ("sq0", 7, {})
    df = text.read_sam(spark, p)
    assert sorted(r[0] for r in df.select(text.sam_line(df)).collect()) == sorted([line, other])
    alignments.write_alignments(df.drop("file").coalesce(1), str(tmp_path / "o.sam"), SamHeader.parse(SAM))
    back = alignments.read_alignments(spark, str(tmp_path / "o.sam"))
    assert back.count() == 2 and alignments.read_alignments(spark, str(tmp_path / "o.sam"), region="sq0:6-7").count() == 1
    bad = put(tmp_path, "b.sam", "r1\tx\tsq0\t3\t60\t4M\t=\t7\t8\tACGT\tIIII\nr1\t99\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_sam(spark, bad).collect()
    assert [r["_corrupt"] is not None for r in text.read_sam(spark, bad, mode="PERMISSIVE").collect()] == [True, True]


def test_strict_lines(spark):
    schema = "name string, flags int, rname string, pos bigint, mapq smallint, cigar string, mate_rname string, mate_pos bigint, tlen int, seq string, qual string"
    good = ("r1", 0, "sq0", 1, 3, "4M", None, None, 0, "ACGT", "IIII")
    line = lambda row: (df := spark.createDataFrame([row], schema)).select(text.sam_line(df, strict=True)).collect()[0][0]
    assert line(good).split("\t")[5] == "4M" and line(("r1", 4, None, None, None, None, None, None, None, None, None)).endswith("\t*\t*")
    for at, bad, what in ((0, "a@b", "read name"), (0, "x" * 255, "read name"), (9, "AC!T", "sequence"), (10, "III", "quality"), (5, "5M", "CIGAR"), (5, "M", "CIGAR")):
        with pytest.raises(Exception, match=f"invalid {what}"):
            line((*good[:at], bad, *good[at + 1 :]))


def test_vcf_text(spark, tmp_path):
    head = '##fileformat=VCFv4.3\n##INFO=<ID=DP,Number=1,Type=Integer,Description="a, \\"b\\"">\n##FILTER=<ID=q10,Description="x">\n##contig=<ID=sq0,length=8>\n##source=me\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\n'
    body = ["sq0\t1\t.\tA\tC,G\t30.5\tPASS\tDP=5;DB\tGT:GQ\t0|1:13\t.", "sq0\t0\ta;b\tA\t.\t.\t.\t.\tGT\t./.\t0/1"]
    p = put(tmp_path, "a.vcf", head + "\n".join(body) + "\n")
    h = VcfHeader.parse(head)
    assert str(VcfHeader.parse(str(h))) == str(h) and h.samples == ["s0", "s1"] and h.type_of("INFO", "DP") == ("1", "Integer") and h.string_map() == {"PASS": 0, "q10": 1, "DP": 2}
    h.insert("FILTER", {"ID": "q20", "Description": "y"})
    h.insert("source", "you")
    assert "q20" in VcfHeader.parse(str(h)).records["FILTER"] and h.other[-1] == ("source", "you")
    with pytest.raises(ValueError, match="repeated"):
        h.insert("FILTER", {"ID": "q20", "Description": "y"})
    got = sorted(text.read_vcf(spark, p).collect(), key=lambda r: r["pos"] or 0)
    assert got[0]["pos"] is None and got[0]["ids"] == ["a", "b"] and got[0]["alt"] == [] and got[0]["qual"] is None
    assert got[1]["info"] == {"DP": "5", "DB": None} and got[1]["samples"] == [{"GT": "0|1", "GQ": "13"}, {}]
    df = text.read_vcf(spark, p)
    assert sorted(r[0] for r in df.select(text.vcf_line(df)).collect()) == sorted([body[0].replace("\t.", "\t.").removesuffix(".") + ".:.", body[1]])
    for bad in ("", head.replace("##fileformat=VCFv4.3\n", ""), head + "x\n", head.replace("POS", "PSO"), head.replace("\ts1", "\ts0"), head.replace("##source", '##FILTER=<ID=q10,Description="x">\n##source'), head.split("#CHROM")[0]):
        with pytest.raises(ValueError):
            VcfHeader.parse(bad)


def test_sam_header():
    h = SamHeader.parse(SAM + "@PG\tID:a\n@PG\tID:b\tPP:a\n@CO\thello\tyou\n")
    assert h.is_coordinate_sorted and h.roots() == ["a"] and h.leaves() == ["b"] and h.comments == ["hello\tyou"] and str(SamHeader.parse(str(h))) == str(h)
    h.add_program("b", VN="1")
    assert h.programs["b-b"] == {"ID": "b-b", "VN": "1", "PP": "b"}
    for bad in ("@SQ\tSN:a\tLN:1\n@SQ\tSN:a\tLN:2\n", "@SQ\tSN:a\n", "@SQ\tSN:a\tLN:0\n", "@SQ\tSN:a\tLN:1\n@HD\tVN:1.6\n", "@XX\tID:a\n", "x\n", "@RG\tID:a\tID:b\n"):
        with pytest.raises(ValueError):
            SamHeader.parse(bad)
    loop = SamHeader.parse("@PG\tID:a\tPP:b\n@PG\tID:b\tPP:a\n")
    with pytest.raises(ValueError, match="cycle"):
        loop.leaves()


def test_bed_gff_gtf(spark, tmp_path):
    p = put(tmp_path, "a.bed", "#c\nsq0\t7\t13\tn\t5\t+\tx\ty\nsq0\t0\t0\t.\t0\t.\n")
    got = [tuple(r)[:7] for r in text.read_bed(spark, p).orderBy("start").collect()]
    assert got == [("sq0", 1, None, None, 0, None, []), ("sq0", 8, 13, "n", 5, "+", ["x", "y"])]
    assert text.read_bed(spark, p, width=3).orderBy("start").collect()[1]["other"] == ["n", "5", "+", "x", "y"]
    gff = "##gff-version 3\nsq0\tSRC\tgene\t8\t13\t.\t+\t.\tgene_id=ndls0;gene_name=gene0\n"
    for tail in ("", "##FASTA\n>sq0\nACGT\n"):
        q = put(tmp_path, f"a{len(tail)}.gff3", gff + tail)
        (r,) = text.read_gff(spark, q).collect()
        assert (r["seqid"], r["start"], r["end"], r["score"], r["strand"], r["phase"], r["attributes"]["gene_id"]) == ("sq0", 8, 13, None, "+", None, ["ndls0"])
    line = text.read_gff(spark, q).select(text.feature_line("gff")).collect()[0][0]
    assert line == gff.split("\n")[1]
    g = put(tmp_path, "a.gtf", '#!x\nsq0\tSRC\tCDS\t8\t13\t0.5\t-\t0\tgene_id "g;1"; n 2;\n')
    (r,) = text.read_gtf(spark, g).collect()
    assert r["attributes"] == {"gene_id": ["g;1"], "n": ["2"]} and r["phase"] == 0
    assert text.read_gtf(spark, g).select(text.feature_line("gtf")).collect()[0][0].endswith('gene_id "g;1"; n "2";')


def test_fasta_and_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">sq0 one two\nACGT\nAC\n>sq1\n\nGGTT\n>sq2\n")
    got = {r["name"]: r for r in text.read_fasta(spark, p).collect()}
    assert (got["sq0"]["description"], got["sq0"]["sequence"], got["sq1"]["sequence"], got["sq2"]["length"]) == ("one two", "ACGTAC", "GGTT", 0)
    assert text.read_fasta(spark, p).where("name = 'sq0'").select(text.fasta_text(4)).collect()[0][0] == ">sq0 one two\nACGT\nAC"
    assert [tuple(r) for r in text.sequence_chunks(text.read_fasta(spark, p).where("name = 'sq0'"), 4).orderBy("chunk").collect()] == [("sq0", 0, "ACGT"), ("sq0", 1, "AC")]
    q = put(tmp_path, "a.fq", "@n:1/1 d e\nAGCT\n+\nabcd\n@n:2/1\nTCGA\n+n:2/1\n@cba\n")
    got = sorted(tuple(r)[:4] for r in text.read_fastq(spark, q).collect())
    assert got == [("n:1/1", "d e", "AGCT", "abcd"), ("n:2/1", None, "TCGA", "@cba")]
    assert text.read_fastq(spark, q).where("name = 'n:1/1'").select(text.fastq_text()).collect()[0][0] == "@n:1/1 d e\nAGCT\n+\nabcd"
    with pytest.raises(Exception, match="malformed"):
        text.read_fastq(spark, put(tmp_path, "b.fq", "@a\nACGT\n+\nabc\n")).collect()


def test_detection(tmp_path):
    import gzip

    for raw, want in ((b"BAM\1", "bam.raw"), (gzip.compress(b"BAM\1"), "bam"), (gzip.compress(b"BCF\2"), "bcf"), (b"CRAM\3", "cram"), (b"##fileformat=VCFv4.3", "vcf"), (gzip.compress(b"##fileformat=VCF"), "vcf.gz"), (b"@HD", "sam"), (gzip.compress(b"@HD"), "sam.gz")):
        assert alignments.detected(raw) == want
    with pytest.raises(ValueError):
        alignments.detected(gzip.compress(b"CRAM"))
