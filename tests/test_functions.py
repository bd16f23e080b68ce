import pytest
from pyspark.sql import functions as F

from strandline.functions import attributes as at
from strandline.functions import bases, bins, flags, modifications, offsets, regions, tags, validate, variants
from strandline.functions import cigar as cg


def one(spark, rows, schema, *cols):
    return [r[0] if len(cols) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_interval_truth_table(spark):
    n = None
    cases = {(5, 8): 1, (4, 6): 1, (4, 5): 1, (7, 9): 1, (8, 9): 1, (4, 9): 1, (6, 7): 1, (1, n): 1, (7, n): 1, (n, 9): 1, (n, 6): 1, (1, 2): 0, (9, 10): 0, (9, n): 0, (n, 2): 0}
    c = F.col
    a = regions.intersects(F.lit(5), F.lit(8), c("s"), c("e"))
    b = regions.intersects(c("s"), c("e"), F.lit(5), F.lit(8))
    assert one(spark, list(cases), "s bigint, e bigint", a, b) == [(bool(v), bool(v)) for v in cases.values()]
    assert one(spark, [(1,), (5,), (9,)], "p bigint", regions.contains(c("p"), F.lit(5), F.lit(None)), regions.contains(c("p"), F.lit(None), F.lit(5))) == [(False, True), (True, True), (True, False)]


def test_region_texts(spark):
    R = regions.Region
    for text, want in {"sq0": R("sq0"), "sq0:5": R("sq0", 5), "sq0:2-5": R("sq0", 2, 5), "a:b:7-9": R("a:b", 7, 9)}.items():
        assert R.parse(text) == want and str(R.parse(text)) == text
    for bad in ("", "sq0:", "sq0:0", "sq0:x", "sq0:5-"):
        with pytest.raises(ValueError):
            R.parse(bad)
    got = one(spark, [("sq0",), ("sq0:5",), ("a:b:7-9",), ("sq0:0",), ("sq0:x",), ("",), (None,)], "t string", regions.region_columns(F.col("t")))
    assert [tuple(g) if g else None for g in got] == [("sq0", None, None), ("sq0", 5, None), ("a:b", 7, 9), None, None, None, None]


def test_bins(spark):
    rows = [(8, 8, 9), (8, 13, 9), (8, 16, 9), (8, 17, 1), (8, 143, 0)]
    assert one(spark, rows, "s bigint, e bigint, b int", bins.reg2bin(F.col("s"), F.col("e"), 4, 2)) == [r[2] for r in rows]
    assert one(spark, [(1, 16), (9, 13), (36, 67)], "s bigint, e bigint", bins.reg2bins(F.col("s"), F.col("e"), 4, 2)) == [[0, 1, 9], [0, 1, 9], [0, 1, 11, 12, 13]]
    assert [bins.plain_reg2bin(r[0], r[1], 4, 2) for r in rows] == [r[2] for r in rows]
    assert (bins.bin_limit(), bins.metadata_bin()) == (37449, 37450)
    assert one(spark, [(None, None), (1, 100)], "s bigint, e bigint", bins.bam_bin(F.col("s"), F.col("e"))) == [4680, 4681]
    assert one(spark, [(0,), (1,), (8,), (9,)], "b int", bins.parent(F.col("b"))) == [None, 0, 0, 1]


def test_cigars(spark):
    c = F.col("c")
    rows = [("5S10M2I3D4N8M",), ("*",), (None,), ("3I",), ("4M",)]
    assert one(spark, rows, "c string", cg.reference_span(c), cg.read_length(c)) == [(25, 25), (None, 0), (None, None), (None, 3), (4, 4)]
    assert one(spark, [("2M2M1I0D1I3M",), ("*",), ("",)], "c string", cg.text(cg.simplified(cg.operations(c)))) == ["4M2I3M", "*", "*"]
    assert one(spark, [("2M",), ("M",), ("2M3",), ("*",), ("",), ("2Q",)], "c string", cg.is_valid(c)) == [True, False, False, True, False, False]


def test_flags_and_bases(spark):
    assert one(spark, [(99,), (0,)], "f int", flags.names(F.col("f"))) == [["is_segmented", "is_properly_segmented", "is_mate_reverse_complemented", "is_first_segment"], []]
    s = F.col("s")
    assert one(spark, [("ACGTRYKMNacgt",), ("",), (None,)], "s string", bases.reverse_complement(s)) == ["acgtNKMRYACGT", "", None]
    with pytest.raises(Exception, match="invalid base"):
        one(spark, [("AC!",)], "s string", bases.complement(s, strict=True))
    assert one(spark, [("!I~",), ("*",), ("",)], "s string", bases.scores(s)) == [[0, 40, 93], None, []]
    assert one(spark, [("!I~",)], "s string", bases.quality_text(bases.scores(s))) == ["!I~"]
    assert one(spark, [("acgt\n x",)], "s string", bases.normalised_md5(s)) == one(spark, [("ACGTX",)], "s string", F.md5("s"))
    assert one(spark, [("ACGTA",)], "s string", bases.subsequence(s, F.lit(2), F.lit(4)), bases.subsequence(s, F.lit(2), F.lit(6)), bases.wrapped(s, 2), bases.four_bit_text(s)) == [("CGT", None, "AC\nGT\nA", "ACGTA")]


def test_attributes(spark):
    t = F.col("t")
    gtf = one(spark, [('id 0; name "ndls";',), (r'a "nd\\ls"; b "nd\"ls\""; a 2',), ("",)], "t string", at.gtf_attributes(t))
    assert gtf == [{"id": ["0"], "name": ["ndls"]}, {"a": ["nd\\ls", "2"], "b": ['nd"ls"']}, {}]
    gff = one(spark, [("gene_id=ndls0;gene_name=gene0",), ("a=1,2%2C3;b=x%3By;a=9",), (".",), (None,), ("junk",)], "t string", at.gff_attributes(t))
    assert gff == [{"gene_id": ["ndls0"], "gene_name": ["gene0"]}, {"a": ["1", "2,3"], "b": ["x;y"]}, {}, {}, {}]
    assert one(spark, [("a%3Bb+c",), ("a%zz",), (None,)], "t string", at.percent_decoded(t)) == ["a;b+c", "a%zz", None]
    assert one(spark, [("##gff-version 3",), ("##FASTA",), ("#x",), ("x",)], "t string", at.directive(t)) == [("gff-version", "3"), ("FASTA", None), None, None]
    assert one(spark, [(">sq0  desc here",), (">sq0",)], "t string", at.definition(t)) == [("sq0", "desc here"), ("sq0", None)]
    assert one(spark, [('a "x\\"y"; b "1"; a "2";',)], "t string", at.gtf_text(at.gtf_attributes(t))) == ['a "x\\"y"; a "2"; b "1";']


def test_genotypes_and_ends(spark):
    g = F.col("g")
    got = one(spark, [("0|0",), ("0/1",), ("|0/1",), ("|1/2|3",), ("./.",), ("1",)], "g string", variants.genotype(g))
    assert [[(x["allele"], x["phased"]) for x in r] for r in got] == [[(0, True), (0, True)], [(0, False), (1, False)], [(0, True), (1, False)], [(1, True), (2, False), (3, True)], [(None, False), (None, False)], [(1, True)]]
    assert one(spark, [("|1/2|.",)], "g string", variants.genotype_text(variants.genotype(g), first_mark=True), variants.genotype_text(variants.genotype(g), first_mark=False)) == [("|1/2|.", "1/2|.")]
    rows = [("ACGT", 8, None), ("ACGT", None, None), ("ACGT", None, [None, 5, 8])]
    c, one_ = F.col, F.lit(1).cast("bigint")
    ends = [variants.variant_end(one_, c("r"), end=c("e"), version=(4, 2)), variants.variant_end(one_, c("r"), end=c("e"), sv_lengths=c("l"), version=(4, 5))]
    assert one(spark, rows, "r string, e bigint, l array<bigint>", *ends) == [(8, 4), (4, 4), (4, 8)]
    m = variants.info_map(F.col("i"))
    assert one(spark, [("DP=5;DB;AF=0.5,.",), (".",)], "i string", variants.info_value(m, "DP", "1", "Integer"), variants.info_value(m, "DB", "0", "Flag"), variants.info_value(m, "AF", "A", "Float")) == [(5, True, [0.5, None]), (None, False, None)]
    assert one(spark, [("0|0:13",), (".",), ("0/1",)], "s string", variants.sample_map(F.lit("GT:GQ"), F.col("s"))) == [{"GT": "0|0", "GQ": "13"}, {}, {"GT": "0/1", "GQ": None}]
    assert one(spark, [("PASS",), (".",), ("PASS;q10",)], "f string", variants.is_pass(variants.filters(F.col("f")))) == [True, False, False]


def test_tags_and_modifications(spark):
    got = one(spark, [(["NH:i:1", "CO:Z:a:b", "XF:f:0.5", "BC:B:c,1,-2", "BF:B:f,0.5"],)], "t array<string>", tags.tag_map(F.col("t")))[0]
    assert (got["NH"]["i"], got["CO"]["s"], got["XF"]["f"], got["BC"]["ai"], got["BF"]["af"]) == (1, "a:b", 0.5, [1, -2], [0.5])
    assert one(spark, [(["NH:i:1", "CO:Z:a:b", "BC:B:c,1,-2"],)], "t array<string>", tags.tag_text(tags.tag_map(F.col("t"))))[0] == ["NH:i:1", "CO:Z:a:b", "BC:B:c,1,-2"]
    assert one(spark, [(["NH:i:3"],), (["CO:Z:x"],)], "t array<string>", tags.integer_tag(tags.tag_map(F.col("t")), "NH")) == [3, None]
    mods = one(spark, [("CACCCGATGACCGGCT", "C+m,1,3,0;G-o,2;")], "s string, m string", modifications.groups(F.col("s"), F.col("m"), F.lit(False)))[0]
    assert [(x["base"], x["strand"], x["modifications"], x["positions"]) for x in mods] == [("C", "+", ["m"], [2, 11, 14]), ("G", "-", ["o"], [12])]


def test_offsets(spark):
    c = F.col
    got = one(spark, [(2**40, 65535), (0, 0)], "c bigint, u int", offsets.unpacked(offsets.virtual_position(c("c"), c("u"))))
    assert [tuple(x) for x in got] == [(2**40, 65535), (0, 0)]
    assert one(spark, [(1,), (80,), (81,)], "s bigint", offsets.fai_offset(F.lit(5), F.lit(80), F.lit(81), c("s"))) == [5, 84, 86]


def test_validators(spark):
    n = F.col("n")
    rows = [("sq0",), ("*x",), ("=x",), ("a*",), ("a,b",), ("",), ("HLA-A*01:01",)]
    assert one(spark, rows, "n string", validate.is_reference_name(n)) == [True, False, False, True, False, False, True]
    assert one(spark, [("a b",), ("",), ("x" * 256,), ("é",)], "n string", validate.is_feature_name(n)) == [True, False, False, False]
