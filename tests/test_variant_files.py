import random

import pytest

from strandline.sources import bcf, bgzf, blocked_text, text, variants
from strandline.sources.headers import VcfHeader

HEAD = """##fileformat=VCFv4.3
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="b">
##INFO=<ID=NO,Number=1,Type=String,Description="s">
##FILTER=<ID=q10,Description="q">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">
##FORMAT=<ID=GL,Number=G,Type=Float,Description="l">
##contig=<ID=sq0,length=100000>
##contig=<ID=sq1,length=100000>
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s0	s1
"""


def body(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        info = rng.choice([".", "DP=5", "DP=70000;DB", "AF=0.5,.;NO=x y", "DB"])
        fmt = rng.choice(["GT:PL:GL\t0|1:1,.,300:0.5,-1.25\t./.:.:.", "GT\t1\t0/1"])
        out.append(f"{'sq0' if i < n // 2 else 'sq1'}\t{(i % (n // 2)) * 7 + 1}\t{rng.choice(['.', 'a', 'a;b'])}\t{rng.choice(['A', 'ACG'])}\t{rng.choice(['C', 'C,G', '.'])}\t{rng.choice(['.', '30.5'])}\t{rng.choice(['.', 'PASS', 'q10'])}\t{info}\t{fmt}")
    return out


def flat(df):
    return sorted(str((r["chrom"], r["pos"], r["ids"], r["ref"], r["alt"], r["qual"], r["filters"], sorted((r["info"] or {}).items()), r["format"], [sorted(s.items(), key=str) for s in r["samples"] or []])) for r in df.collect())


def test_binary_roundtrip(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(HEAD + "\n".join(body(200)) + "\n")
    df, header = variants.read_variants(spark, str(p)), VcfHeader.parse(HEAD)
    variants.write_variants(df.repartition(2), str(tmp_path / "o.bcf"), header)
    assert flat(variants.read_variants(spark, str(tmp_path / "o.bcf"))) == flat(df)
    assert variants.read_variants(spark, str(tmp_path / "o.bcf"), region="sq0:1-50").count() == variants.read_variants(spark, str(p), region="sq0:1-50").count() > 0
    variants.write_variants(df.coalesce(1), str(tmp_path / "o.vcf"), header)
    assert flat(variants.read_variants(spark, str(tmp_path / "o.vcf"))) == flat(df)


def test_binary_index(spark, tmp_path):
    rows = body(8000)
    (tmp_path / "a.vcf").write_text(HEAD + "\n".join(rows) + "\n")
    df = variants.read_variants(spark, str(tmp_path / "a.vcf"))
    bcf.write_bcf(df.coalesce(1), str(tmp_path / "o"), VcfHeader.parse(HEAD))
    (p,) = bcf._files(str(tmp_path / "o"))
    bcf.write_index(p)
    for region in ("sq0:1000-1100", "sq1:20000", "sq1", "sq9"):
        assert flat(variants.read_variants(spark, p, region=region)) == flat(variants.read_variants(spark, str(tmp_path / "a.vcf"), region=region))
    few = bcf._Reader({"path": p, "region": "sq1:27000-27100"})
    assert sum(b.num_rows for x in few.partitions() for b in few.read(x)) < 4000


def test_typed_values():
    c = bcf._Cursor(bcf.typed_ints([1, None, 300], 5) + bcf.typed_floats([0.5, None]) + bcf.typed_text("abcdefghijklmnopqrst") + bcf.typed_ints([70000]) + bcf.typed_ints([-121, 127]))
    assert [c.typed() for _ in range(5)] == [[1, None, 300], [0.5, None], ["abcdefghijklmnopqrst"], [70000], [-121, 127]]
    assert bcf.genotype_text([2, 5], (4, 3)) == "0|1" and bcf.genotype_text([0, 0], (4, 3)) == "./." and bcf.genotype_text([5], (4, 4)) == "|1"


def test_blocked_text_splits_and_regions(spark, tmp_path):
    rows = body(20000)
    p = str(tmp_path / "a.vcf.gz")
    blocked_text.compress(iter(HEAD.rstrip("\n").split("\n") + rows), p)
    want = HEAD.rstrip("\n").split("\n") + rows
    for size in (1 << 30, 30_000, 7_000):
        r = blocked_text._Reader({"path": p, "task_bytes": str(size)})
        assert [x.decode() for piece in r.partitions() for x in blocked_text.lines_of(piece)] == want
    assert variants.read_variants(spark, p).count() == len(rows)
    for csi in (False, True):
        blocked_text.write_index(p, "vcf", csi=csi)
        for region, name, lo, hi in (("sq0:1000-1100", "sq0", 1000, 1100), ("sq1:69000", "sq1", 69000, 10**9), ("sq1", "sq1", 1, 10**9)):
            near = [x for x in rows if x.split("\t")[0] == name and int(x.split("\t")[1]) <= hi and int(x.split("\t")[1]) + len(x.split("\t")[3]) - 1 >= lo]
            assert variants.read_variants(spark, p, region=region).count() == len(near)
            assert blocked_text.read_lines(spark, p, region=region).count() < len(rows)
            if region != "sq1":
                assert abs(blocked_text.read_indexed_fields(spark, p, region).count() - len(near)) <= 1  # the generic fields know no end
        assert variants.read_variants(spark, p, region="sq9:1-2").count() == 0
        (tmp_path / ("a.vcf.gz.csi" if csi else "a.vcf.gz.tbi")).unlink()


def test_bed_and_gff_regions(spark, tmp_path):
    p = str(tmp_path / "a.bed.gz")
    blocked_text.compress((f"sq0\t{i * 10}\t{i * 10 + 5}" for i in range(500)), p)
    blocked_text.write_index(p, "bed")
    assert [r["start"] for r in blocked_text.read_region(spark, p, "bed", "sq0:1001-1015").orderBy("start").collect()] == [1001, 1011]
    g = str(tmp_path / "a.gff.gz")
    blocked_text.compress((f"sq0\t.\tgene\t{i * 10 + 1}\t{i * 10 + 5}\t.\t+\t.\tID=g{i}" for i in range(500)), g)
    blocked_text.write_index(g, "gff")
    assert [r["attributes"]["ID"] for r in blocked_text.read_region(spark, g, "gff", "sq0:1005-1011").orderBy("start").collect()] == [["g100"], ["g101"]]
    with pytest.raises(ValueError):
        blocked_text.read_region(spark, g, "xyz", "sq0")
    assert bgzf.has_eof(open(g, "rb"))
