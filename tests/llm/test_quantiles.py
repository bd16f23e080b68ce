import numpy as np
from pyspark.sql import functions as F

from strandline.llm import quantiles as Q


def test_codes_keep_order_and_size(spark):
    vs = sorted({0, 1, -1, 2047, 2048, 2049, 4095, 4096, 65535, 10**6, 2**31 - 1, -(2**31), -5, -2048, -70000, *range(1000, 6000, 7)})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vs], "v bigint").select(Q.encoded(F.col("v"))).collect()]
    assert got == sorted(got) and min(got) >= 0 and max(got) < 2**Q.BITS
    back = Q.decoded(np.array(got))
    assert all(abs(b - v) <= abs(v) / 2**11 for b, v in zip(back, vs)) and all(b == v for b, v in zip(back, vs) if abs(v) < 2048)


def test_all_64_bit_values_have_codes(spark):
    vs = [-(2**63), -(2**63) + 1, -(2**60), -(2**41), -(2**41) + 1, -3, 0, 3, 2**41 - 1, 2**41, 2**45, 2**60, 2**63 - 1]
    got = np.array([r[0] for r in spark.createDataFrame([(v,) for v in vs], "v bigint").select(Q.encoded(F.col("v"))).collect()])
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < 2**Q.BITS
    assert all(abs(float(b) - v) <= abs(v) / 2**11 for b, v in zip(Q.decoded(got), vs))


def test_sketches_survive_packing():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 2**Q.BITS, 5000)
    for weight in (1, 100, 10**6, -(10**12)):
        (s,) = Q._sketches(np.zeros(5000, int), code, np.full(5000, weight), 1, 512)
        t = Q.Sketch.unpacked(s.packed())
        assert (t.signed == s.signed).all() and (t.exact == s.exact).all() and t.total == 5000 * weight


def exact(v, p):
    return np.sort(v)[max(int(np.ceil(p * len(v))), 1) - 1]


def test_rank_error_merging_and_deletion(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.normal(300, 80, 20000).astype(int), rng.integers(-(10**7), 10**7, 2000)))
    gone = rng.integers(0, 1000, 3000)
    rows = [(int(x), i % 3, 1) for i, x in enumerate(v)] + [(int(x), 9, 1) for x in gone] + [(int(x), 9, -1) for x in gone] + [(None, 0, 1)]
    df = spark.createDataFrame(rows, "value bigint, day int, w int").withColumn("g", F.lit("a")).withColumn("level", F.lit(1))
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    whole = Q.percentiles(Q.merge(Q.sketch(df, ["g"], "value", weight=F.col("w")), ["g"]), ["g"], ps).collect()
    days = Q.merge(Q.sketch(df, ["g", "day"], "value", weight=F.col("w"), buffer_rows=1000), ["g"])
    assert sorted(map(tuple, Q.percentiles(days, ["g"], ps).collect())) == sorted(map(tuple, whole))
    for r in whole:
        assert r["n"] == len(v)
        low, high = np.mean(v < r["value"] * (1 - 2**-10) - 1), np.mean(v <= r["value"] * (1 + 2**-10) + 1)
        assert low - r["rank_error"] <= r["probability"] <= high + r["rank_error"] and r["rank_error"] < Q.ERROR and r["low"] <= r["value"] <= r["high"]


def test_small_values_are_nearly_exact_and_empty_groups_give_nothing(spark):
    df = spark.createDataFrame([(v % 61, None if v % 2 else 1, "x") for v in range(5000)], "value int, g int, code string")
    got = Q.percentiles(Q.merge(Q.sketch(df, ["g"], "value"), ["g"]), ["g"], [0.5]).collect()
    for r in got:
        v = np.array([x % 61 for x in range(5000) if (x % 2 == 0) == (r["g"] == 1)])
        assert abs(np.mean(v <= r["value"]) - 0.5) <= r["rank_error"] + 1 / 61
    assert len(got) == 2
    assert Q.percentiles(Q.merge(Q.sketch(df.limit(0), ["g"], "value"), ["g"]), ["g"], [0.5]).count() == 0
    assert Q.percentiles(Q.merge(Q.sketch(df, ["g"], "value", weight=F.lit(0)), ["g"]), ["g"], [0.5]).count() == 0
    whole = Q.percentiles(Q.merge(Q.sketch(df, [], "value"), []), [], [0.5]).collect()
    assert len(whole) == 1 and whole[0]["n"] == 5000


def test_a_smaller_error_takes_more_counters():
    assert Q.width(0.01) == 2048 and Q.width(0.001) == 16384
