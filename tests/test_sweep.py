import random

from strandline.operators.sweep import LAST, covered_and_gaps


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "f bigint, s string, a bigint, z bigint, kind string, _p int")
    return sorted(((r.f, r.s, r.kind, r.first_position, r.last_position) for r in covered_and_gaps(df, ["f", "s"], "a", "z", **how).collect()), key=str)


def brute(rows):
    out = []
    for key in {r[:2] for r in rows}:
        covered = sorted({p for f, s, a, z in rows if (f, s) == key and a is not None and z is not None for p in range(a, z + 1)})
        spans = []
        for p in covered:
            if spans and spans[-1][1] == p - 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        out += [(*key, "period", a, z) for a, z in spans] + [(*key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(spans, spans[1:])]
    return sorted(out, key=str)


def test_random_intervals_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["p", "q", None]), s, s + rng.randint(-2, 9)) for s in (rng.randint(-40, 400) for _ in range(400))]
    rows += rows[:20] + [(1, "p", None, 5), (1, "p", 5, None)]
    for tile_bits in (1, 4, 16):
        assert run(spark, rows, tile_bits=tile_bits) == brute(rows)


def test_adjacent_nested_extreme_and_empty(spark):
    assert run(spark, [(1, "p", 1, 5), (1, "p", 6, 9), (1, "p", 2, 3)]) == [(1, "p", "period", 1, 9)]
    assert run(spark, [(1, "p", 5, LAST), (1, "p", 1, 2)]) == [(1, "p", "gap", 3, 4), (1, "p", "period", 1, 2), (1, "p", "period", 5, LAST)]
    assert run(spark, []) == [] and run(spark, [(1, "p", 5, 4)]) == []
    assert run(spark, [(1, "p", 1, 2), (1, "p", 200000, 200001)], gaps=False) == [(1, "p", "period", 1, 2), (1, "p", "period", 200000, 200001)]
