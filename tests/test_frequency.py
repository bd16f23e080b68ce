import math
import random
from collections import Counter

from strandline.operators.frequency import key_profile


def test_profile_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(-3000, 3000, 37)]), "x") for _ in range(1500)] + [(3, None, "x"), (4, 5, "x")]
    ps = (0.0, 0.1, 0.5, 1.0)
    got = {r["key"]: r for r in key_profile(spark.createDataFrame(rows, "k int, v int, _n string"), "k", ["v"], ps).collect()}
    assert set(got) == {1, 2, None, 4}
    for k, r in got.items():
        v = sorted(x for a, x, _ in rows if a == k and x is not None)
        top = max(Counter(v).items(), key=lambda x: (x[1], -x[0]))[0]
        assert (r["n"], r["distinct"], r["mode"]) == (len(v), len(set(v)), top)
        assert [(p["probability"], p["value"]) for p in r["percentiles"]] == [(p, v[max(math.ceil(p * len(v)), 1) - 1]) for p in ps]


def test_empty(spark):
    assert key_profile(spark.createDataFrame([], "k int, v int"), "k", ["v"], (0.5,)).count() == 0


def test_wide_values_over_all_digits(spark):
    rng = random.Random(5)
    rows = [(1, rng.choice([-(2**63), 2**63 - 1, rng.randrange(-(2**62), 2**62), rng.randrange(-9, 9), -1, 0])) for _ in range(400)]
    ps = (0.0, 0.01, 0.3, 0.5, 0.77, 1.0)
    (r,) = key_profile(spark.createDataFrame(rows, "k int, v bigint"), "k", ["v"], ps).collect()
    v = sorted(x for _, x in rows)
    assert [p["value"] for p in r["percentiles"]] == [v[max(math.ceil(p * len(v)), 1) - 1] for p in ps]
