import gzip

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from strandline.functions import tags as tg
from strandline.functions import variants as vf
from strandline.sources import alignments, bam, bgzf, blocked_text, fastq, storage, text, variants
from strandline.sources.headers import SamHeader, VcfHeader

HEADER = SamHeader.parse("@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:sq0\tLN:100000\n")
ROWS = [(f"r{i}", 0, "sq0", i * 10 + 1, 60, "4M", None, None, 0, "ACGT", "IIII", {"NH": bam._value("i", i=i)}) for i in range(2000)]


def test_another_file_system_is_read_and_written_in_the_same_way(tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_elsewhere", lambda path: (fs.LocalFileSystem(), str(tmp_path) + path.removeprefix("mem://x")))
    assert storage.local("mem://x/a") is None and storage.local("file:///a/b") == "/a/b" and storage.local("/a") == "/a"
    storage.make_folder("mem://x/d")
    with storage.writing("mem://x/d/a.bin") as f:
        f.write(b"hello")
    storage.rename("mem://x/d/a.bin", "mem://x/d/b.bin")
    assert storage.exists("mem://x/d/b.bin") and not storage.exists("mem://x/d/a.bin") and storage.size("mem://x/d/b.bin") == 5 and storage.is_folder("mem://x/d")
    with storage.reading("mem://x/d/b.bin") as f:
        f.seek(1)
        assert f.read(3) == b"ell"
    with storage.writing("mem://x/d/t.gz") as f:
        w = bgzf.Writer(f)
        w.write(b"x" * 100000)
        w.close()
    with storage.reading("mem://x/d/t.gz") as f:
        assert len(bgzf.Reader(f).read()) == 100000
    storage.remove("mem://x/d/b.bin")
    assert not storage.exists("mem://x/d/b.bin")


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:10], bam.SCHEMA)
    for fmt in ("bam", "cram"):
        with pytest.raises(Exception):
            alignments.write_alignments(df.withColumn("rname", F.when(F.col("pos") > 50, "nope").otherwise(F.col("rname"))).repartition(3), str(tmp_path / fmt), HEADER, fmt=fmt)
        assert storage.listed(str(tmp_path / fmt)) == []


def test_compressed_text_alignments_are_cut_and_use_their_index(spark, tmp_path):
    out = str(tmp_path / "o.sam.gz")
    alignments.write_alignments(spark.createDataFrame(ROWS, bam.SCHEMA).coalesce(1), out, HEADER)
    (p,) = storage.listed(out, (".gz",))
    assert alignments.format_of(out) == "sam.gz" and alignments.read_alignments(spark, out).count() == 2000
    blocked_text.write_index(p, "sam")
    assert sorted(r["pos"] for r in alignments.read_alignments(spark, p, region="sq0:1002-1021").collect()) == [1001, 1011, 1021]
    assert blocked_text.read_lines(spark, p, region="sq0:1-100").count() < 2000
    (tmp_path / "plain.sam.gz").write_bytes(gzip.compress(b"r1\t0\tsq0\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\n"))
    assert alignments.read_alignments(spark, str(tmp_path / "plain.sam.gz")).count() == 1


VCF = """##fileformat=VCFv4.3
##INFO=<ID=XX,Number=2,Type=Float,Description="x">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="q">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1
"""


def test_header_types_info_and_samples_and_reheading(spark, tmp_path):
    head = VcfHeader.parse(VCF)
    (tmp_path / "a.vcf").write_text(VCF + "sq0\t5\t.\tA\tC\t.\t.\tXX=0.5,.;DP=7;DB;ZZ=q\tGT:GQ\t0|1:13\t.\nsq0\t9\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1\n")
    df = variants.read_variants(spark, str(tmp_path / "a.vcf")).orderBy("pos")
    got = variants.typed_info(df, head, ["XX", "DP", "DB", "ZZ"]).select("XX", "DP", "DB", "ZZ").collect()
    assert [tuple(r) for r in got] == [([0.5, None], 7, True, "q"), (None, None, False, None)]
    assert variants.typed_info(df, head).columns[-1] == "XX"
    assert [tuple(r) for r in df.select(variants.sample_column(df, head, "s0", "GQ"), variants.sample_column(df, head, "s1", "GT")).collect()] == [(13, None), (None, "1")]
    with pytest.raises(ValueError):
        variants.sample_column(df, head, "s9", "GT")
    variants.write_variants(df.coalesce(1), str(tmp_path / "o.vcf.gz"), head)
    (p,) = storage.listed(str(tmp_path / "o.vcf.gz"), (".gz",))
    head.insert("source", "me")
    blocked_text.reheader(p, str(head), str(tmp_path / "n.vcf.gz"))
    with open(tmp_path / "n.vcf.gz", "rb") as f:
        lines = bgzf.Reader(f).read().decode().split("\n")
    assert "##source=me" in lines and lines.count(lines[0]) == 1 and variants.read_variants(spark, str(tmp_path / "n.vcf.gz")).count() == 2


def test_edits_of_tags_and_info(spark):
    row = spark.createDataFrame([({"NH": bam._value("i", i=1), "CO": bam._value("Z", s="a")},), (None,)], f"tags map<string,{tg.TAG_STRUCT}>")
    out = row.select(tg.tag_text(tg.without_tag(tg.with_tag(tg.with_tag(F.col("tags"), "NH", "i", F.lit(5)), "XF", "f", F.lit(0.5)), "CO")).alias("t")).collect()
    assert [r["t"] for r in out] == [["NH:i:5", "XF:f:0.5"], ["NH:i:5", "XF:f:0.5"]]
    info = spark.createDataFrame([("DP=5;DB;X=1",), (".",)], "i string").select(vf.info_map(F.col("i")).alias("m"))
    out = info.select(vf.info_text(vf.without_info(vf.with_info(vf.with_info(F.col("m"), "DP", F.lit(9)), "NEW", F.lit(None)), "X")).alias("t")).collect()
    assert [r["t"] for r in out] == ["DP=9;DB;NEW", "DP=9;NEW"]


def test_names_outside_the_dictionary_raise(spark):
    good = "r1\t0\tsq0\t3\t60\t4M\t=\t7\t0\tACGT\tIIII"
    lines = lambda x: text.sam_columns(spark.createDataFrame([(x,)], "value string"))
    assert text.in_dictionary(lines(good), HEADER).count() == 1
    for bad in (good.replace("sq0", "sq1"), good.replace("=", "sq2")):
        with pytest.raises(Exception, match="not in the dictionary"):
            text.in_dictionary(lines(bad), HEADER).collect()


def test_reads_are_cut_by_bytes(spark, tmp_path):
    reads = [(f"n{i}", "ACGT"[: 1 + i % 4] * 3, "@+I@"[: 1 + i % 4] * 3) for i in range(500)]
    p = tmp_path / "a.fq"
    p.write_text("".join(f"@{n} d\n{s}\n+\n{q}\n" for n, s, q in reads))
    for size in (1 << 20, 900, 101):
        r = fastq._Reader({"paths": str(p), "task_bytes": str(size)})
        assert [(x["name"], x["sequence"], x["quality"]) for piece in r.partitions() for b in r.read(piece) for x in b.to_pylist()] == reads
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(p.read_bytes()))
    assert text.read_fastq(spark, [str(p), str(tmp_path / "b.fq.gz")]).count() == 1000


def test_directives_before_features(spark, tmp_path):
    df = spark.createDataFrame([("sq0", None, "gene", 1, 5, None, "+", None, {"ID": ["a"]})], "seqid string, source string, type string, start bigint, end bigint, score float, strand string, phase tinyint, attributes map<string,array<string>>")
    text.write_features(df.coalesce(1), str(tmp_path / "o"), "gff", directives=["##gff-version 3", "# made"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["##gff-version 3", "# made", "sq0\t.\tgene\t1\t5\t.\t+\t.\tID=a"]
    with pytest.raises(ValueError):
        text.write_features(df, str(tmp_path / "p"), "gff", directives=["x"])


def test_files_that_are_not_compressed(spark, tmp_path):
    bam.write_bam(spark.createDataFrame(ROWS, bam.SCHEMA).coalesce(1), str(tmp_path / "b"), HEADER)
    (p,) = storage.listed(str(tmp_path / "b"), (".bam",))
    with open(p, "rb") as f:
        (tmp_path / "raw.bam").write_bytes(bgzf.Reader(f).read())
    assert alignments.format_of(str(tmp_path / "raw.bam")) == "bam.raw"
    assert alignments.read_alignments(spark, str(tmp_path / "raw.bam")).count() == 2000
    assert alignments.read_alignments(spark, str(tmp_path / "raw.bam"), region="sq0:1002-1021").count() == 3
    (tmp_path / "a.vcf").write_text(VCF + "sq0\t5\t.\tA\tC\t.\t.\tXX=0.5,.\tGT:GQ\t0|1:13\t.\n")
    head = VcfHeader.parse(VCF)
    head.insert("contig", {"ID": "sq0"})
    head.insert("FORMAT", {"ID": "GT", "Number": "1", "Type": "String", "Description": "g"})
    variants.write_variants(variants.read_variants(spark, str(tmp_path / "a.vcf")).coalesce(1), str(tmp_path / "v.bcf"), head)
    (q,) = storage.listed(str(tmp_path / "v.bcf"), (".bcf",))
    with open(q, "rb") as f:
        (tmp_path / "raw.bcf").write_bytes(bgzf.Reader(f).read())
    assert variants.read_variants(spark, str(tmp_path / "raw.bcf")).select("chrom", "pos").collect() == [("sq0", 5)]


def test_sql_functions_of_operations_and_genotypes(spark):
    from strandline.functions import sql

    sql.register(spark)
    r = spark.sql("select cigar_operations('5S10M') a, cigar_simplified('5M5M0I2D') b, cigar_simplified('*') c, genotype('0/1') d, genotype('|1/2|3') e, genotype('./.') f, genotype('1') g, info_entry('DP=5;DB', 'DP') h, base_modification_codes('C+m,1;G-76792,2;') i").first()
    assert [tuple(x) for x in r["a"]] == [(5, "S"), (10, "M")] and r["b"] == "10M2D" and r["c"] == "*"
    assert [tuple(x) for x in r["d"]] == [(0, False), (1, False)] and [tuple(x) for x in r["e"]] == [(1, True), (2, False), (3, True)]
    assert [tuple(x) for x in r["f"]] == [(None, False), (None, False)] and [tuple(x) for x in r["g"]] == [(1, True)] and r["h"] == "5" and r["i"] == ["m", "76792"]
