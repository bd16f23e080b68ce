import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from strandline.operators.orphans import _hot_keys, lifetimes, orphan_counts, orphan_references, probe_held


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, refs, parents, held=False):
    r = spark.createDataFrame([(i, k, day(t), "x") for i, (k, t) in enumerate(refs)], "rid bigint, k int, at timestamp, id string")
    p = spark.createDataFrame([(k, day(a), day(z), 1) for k, a, z in parents], "k int, added_at timestamp, removed_at timestamp, t int")
    if held:
        return probe_held(r, lifetimes(p, "k", "added_at", "removed_at"), "k", record_id="rid", at="at", max_rows=1000)
    return orphan_references(r, {"k": (p, "k")}, record_id="rid", at="at")


def brute(refs, parents):
    ok = lambda k, t: t is not None and any(p == k and a is not None and a <= t and (z is None or t < z) for p, a, z in parents)
    return sorted(i for i, (k, t) in enumerate(refs) if k is not None and k >= 0 and not ok(k, t))


@pytest.mark.parametrize("held", [False, True])
def test_both_ways_match_brute_force(spark, held):
    rng = random.Random(3)
    parents = [(rng.randint(0, 30), a, rng.choice([None, a + rng.randint(-1, 20)])) for a in (rng.randint(0, 300) for _ in range(60))] + [(None, 1, 2), (5, None, None)]
    refs = [(rng.choice([7, 7, rng.randint(-2, 40), None]), rng.choice([rng.randint(0, 320)] * 9 + [None])) for _ in range(600)]
    got = run(spark, refs, parents, held=held)
    assert sorted(r["record_id"] for r in got.collect()) == brute(refs, parents)
    assert got.columns == ["record_id", "field_name", "key", "at"]


@pytest.mark.parametrize("held", [False, True])
def test_empty_sides_and_bounds_of_lifetimes(spark, held):
    assert run(spark, [], [(1, 0, None)], held=held).count() == 0
    assert run(spark, [(1, 5), (1, 5)], [], held=held).count() == 2
    got = run(spark, [(1, 4), (1, 5), (1, 9), (1, 10)], [(1, 5, 10)], held=held)
    assert sorted(r["record_id"] for r in got.collect()) == [0, 3]


def test_several_fields_and_kept_columns_in_one_pass(spark):
    refs = spark.createDataFrame([(1, 1, 9, day(3), "a"), (2, None, 1, day(3), "b"), (3, 2, -1, day(3), None), (None, 1, 1, None, "d")], "rid bigint, x int, y int, at timestamp, s string")
    xs = spark.createDataFrame([(1, day(0), None)], "id int, added_at timestamp, removed_at timestamp")
    ys = spark.createDataFrame([(k, day(0), None) for k in (1, 2, 3, 4)], xs.schema)
    got = orphan_references(refs, {"x": (xs, "id"), "y": (ys, "id")}, record_id="rid", at="at", keep=["s"])
    assert got.columns == ["s", "record_id", "field_name", "key", "at"]
    assert sorted(map(str, ((r["s"], r["record_id"], r["field_name"], r["key"]) for r in got.collect()))) == sorted(map(str, [("a", 1, "y", 9), (None, 3, "x", 2), ("d", None, "x", 1), ("d", None, "y", 1)]))


def test_the_plan_is_range_partitioned_and_a_hot_key_is_salted(spark):
    refs = spark.createDataFrame([(i, 7 if i % 3 else i, day(i % 40)) for i in range(3000)], "rid bigint, k int, at timestamp")
    hot = {(r["f"], r["k"]): r["n"] for r in _hot_keys(refs.select(F.lit(0).alias("f"), F.col("k").cast("bigint").alias("k")), 4).collect()}
    assert hot[(0, 7)] >= 3
    parents = spark.createDataFrame([(7, day(3), day(30)), (9, day(0), None)], "k int, added_at timestamp, removed_at timestamp")
    found = orphan_references(refs, {"k": (parents, "k")}, record_id="rid", at="at")
    assert "rangepartitioning" in found._jdf.queryExecution().toString()
    want = [i for i in range(3000) if not ((i % 3 and 3 <= i % 40 < 30) or i == 9)]
    assert sorted(r["record_id"] for r in found.collect()) == want


def test_parents_beyond_the_bound_are_refused(spark):
    p = spark.createDataFrame([(k, day(0), None) for k in range(5)], "k int, added_at timestamp, removed_at timestamp")
    with pytest.raises(ValueError, match="more than 3"):
        probe_held(p, lifetimes(p, "k", "added_at", "removed_at"), "k", record_id="k", at="added_at", max_rows=3)


def test_counts_by_month(spark):
    got = orphan_counts(run(spark, [(1, 0), (1, 3), (1, 40), (1, None)], []), ["field_name"])
    assert {(r["field_name"], r["month"], r["orphans"]) for r in got.collect()} == {("k", "2024-01", 2), ("k", "2024-02", 1), ("k", None, 1)}
