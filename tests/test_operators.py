import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import convert, statistics
from strandline.operators.depth import depth_runs, per_position
from strandline.operators.overlap import overlap_join


def depths(spark, rows, **how):
    df = spark.createDataFrame(rows, "r string, s bigint, c string, f int")
    runs = depth_runs(df, name="r", start="s", cigar="c", flags="f", **how)
    return sorted((r["r"], r["position"], r["depth"]) for r in per_position(runs).collect())


def test_pileup_cases(spark):
    reads = [("a", s, c, 0) for s, c in ((2, "3M"), (2, "4M"), (3, "2M"), (4, "2M"), (7, "2M"), (7, "3M"))]
    assert [d[1:] for d in depths(spark, reads)] == [(2, 2), (3, 3), (4, 4), (5, 2), (7, 2), (8, 2), (9, 1)]
    assert [d[1:] for d in depths(spark, [("a", 1, "2M2D2M", 0)])] == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 1)]
    assert [d[1] for d in depths(spark, [("a", 1, "2M2D2M", 0)], zero_in_span=False)] == [1, 2, 5, 6]
    assert depths(spark, [("a", 1, "2M", 4), (None, 1, "2M", 0), ("a", None, "2M", 0), ("a", 1, "*", 0), ("a", 1, "2M", None)]) == [] == depths(spark, [])


def test_depth_matches_brute_force(spark):
    rng = random.Random(1)
    reads = [(rng.choice("aab"), rng.randint(1, 300), rng.choice(["5M", "3M2D4M", "2S4M1I3M", "1M30N2M", "4=1X2M"]), rng.choice([0, 0, 16, 1024])) for _ in range(200)]
    want = {}
    for r, s, c, f in reads:
        if f & 0x704:
            continue
        at, n = s, 0
        for ch in c:
            if ch.isdigit():
                n = n * 10 + int(ch)
                continue
            if ch in "M=XDN":
                for p in range(at, at + n):
                    want[r, p] = want.get((r, p), 0) + (ch in "M=X")
                at += n
            n = 0
    for bits in (2, 16):
        assert depths(spark, reads, tile_bits=bits) == sorted((*k, v) for k, v in want.items())


def test_overlap_join_matches_naive(spark):
    rng = random.Random(2)

    def side(n):
        out = [(rng.choice(["x", "x", "y", None]), s, s + rng.choice([0, 5, 40, 3000, -3])) for s in (rng.randint(-2, 5000) for _ in range(n))]
        return [(i, *r) for i, r in enumerate([*out, ("x", None, 5), ("x", 5, None), ("x", 1, 10**6), ("x", 3000, 2**63 - 1)])]

    a, b = side(150), side(80)
    schema = "id int, n string, s bigint, e bigint"
    want = sorted((p[0], q[0]) for p in a for q in b if None not in p + q and p[1] == q[1] and p[2] >= 1 and q[2] >= 1 and p[3] >= p[2] and q[3] >= q[2] and p[2] <= q[3] and q[2] <= p[3])
    l, r = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for bits in (1, 4, 14):
        got = overlap_join(l, r, left_on=("n", "s", "e"), right_on=("n", "s", "e"), tile_bits=bits)
        assert sorted((x["left"]["id"], x["right"]["id"]) for x in got.collect()) == want
    joined = overlap_join(l, r, left_on=("n", "s", "e"), right_on=("n", "s", "e"), tile_bits=4)
    assert "SortMergeJoin" in joined._jdf.queryExecution().toString() or "HashJoin" in joined._jdf.queryExecution().toString()
    assert overlap_join(l.limit(0), r, left_on=("n", "s", "e"), right_on=("n", "s", "e")).count() == 0


def test_flag_statistics(spark):
    rows = [(99, 1, 1, 60), (147, 1, 2, None), (4, None, None, None), (0x100, 1, None, 3), (0x200 | 1, 1, 2, 3), (1, 1, 2, 3), (None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "f int, r int, m int, q int")
    got = {r["qc_fail"]: r.asDict() for r in statistics.flagstat(df, flags="f", reference=F.col("r"), mate_reference=F.col("m"), mapping_quality=F.col("q")).collect()}
    p = got[False]
    assert (p["read"], p["mapped"], p["secondary"], p["primary"], p["paired"], p["proper_pair"], p["mate_reference_mismatch"], p["mate_reference_mismatch_hq"]) == (5, 4, 1, 4, 3, 2, 2, 1)
    assert got[True]["read"] == 1 and got[True]["mate_reference_mismatch_hq"] == 0
    assert [r[0] for r in spark.createDataFrame([(1, 3), (0, 0)], "a int, b int").select(statistics.percent(F.col("a"), F.col("b"))).collect()] == ["33.33%", "N/A"]


def test_sequence_index(spark):
    def fai(texts):
        rows, at = [], 5
        for i, t in enumerate(texts):
            rows.append(("sq0", i, at, t))
            at += len(t) + 1
        return [tuple(r) for r in statistics.fai(spark.createDataFrame(rows, "n string, i int, o bigint, l string"), name="n", number="i", offset="o", line="l").collect()]

    assert fai(["ACGT", "ACGT", "AC"]) == [("sq0", 10, 5, 4, 5)]
    for bad in (["ACGT", "ACG", "ACGT"], ["ACGT", "ACGTN"]):
        with pytest.raises(Exception, match="uneven lines"):
            fai(bad)


def test_conversions(spark):
    rows = [("r", 16, "ACG", "!5I"), ("s", 0, "AC", "II"), ("t", 0x100, "A", "I")]
    df = spark.createDataFrame(rows, "name string, f int, s string, q string")
    assert sorted(tuple(r) for r in convert.to_reads(df, name="name", flags="f", seq="s", quality="q").collect()) == [("r", "CGT", "I5!"), ("s", "AC", "II")]
    with pytest.raises(Exception, match="paired"):
        convert.to_reads(spark.createDataFrame([("r", 1, "A", "I")], df.schema), name="name", flags="f", seq="s", quality="q").collect()
    assert {r["name"]: r["f"] for r in convert.reset(df, flags="f", seq="s", quality="q").collect()} == {"r": 4, "s": 4}
    groups = spark.createDataFrame([(1, "g1")], "id int, label string")
    reads = spark.createDataFrame([(1, 1), (2, None)], "n int, rg int")
    assert [tuple(r) for r in convert.split_by_group(reads, groups, group="rg", key="id", label="label").collect()] == [(1, 1, "g1")]
    with pytest.raises(Exception, match="unknown read group"):
        convert.split_by_group(spark.createDataFrame([(1, 9)], reads.schema), groups, group="rg", key="id", label="label").collect()
