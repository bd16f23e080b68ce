import os

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing as X
from strandline.llm.queries import VOCABULARY


def sources():
    return [X.Source("a", 1000, 0.5, 1), X.Source("b", 500, 0.3, 2), X.Source("c", 50, 0.2, 2), X.Source("d", 0, 0.1, 3)]


def test_plans():
    s, total, a = X.plan(sources(), policy="exact")
    assert a == 0.0 and abs(total - 500) < 1e-6 and [round(x.budget, 6) for x in s] == [250, 150, 100, 0]
    s, total, a = X.plan(sources())
    assert 0 < a <= 1 and total == 1550 and all(x.budget <= x.tokens * x.max_repeats + 1e-6 for x in s) and abs(sum(x.budget for x in s) - 1550) < 1e-3
    natural, target = [1000 / 1550, 500 / 1550, 50 / 1550], [0.5, 0.3, 0.2]
    raw = [t * (n / t) ** a for n, t in zip(natural, target)]
    assert all(abs(x.weight - r / sum(raw)) < 1e-9 for x, r in zip(s, raw))
    assert abs(max(x.budget - x.tokens * x.max_repeats for x in s)) < 1e-3  # the scarcest source is used to its cap
    s, total, a = X.plan(sources(), 300)
    assert a == 0.0 and total == 300 and [round(x.weight, 9) for x in s] == [0.5, 0.3, 0.2, 0]
    s, _, a = X.plan(sources(), 300, base="equal", most_entropy=X.entropy([0.7, 0.28, 0.02]))
    assert 1 < a < 2 and abs(X.entropy([x.weight for x in s]) - X.entropy([0.7, 0.28, 0.02])) < 1e-6
    assert X.plan([X.Source("a", 0, 1.0, 1)])[1] == 0.0
    with pytest.raises(ValueError):
        X.plan(sources(), policy="other")


def test_selection_meets_shares_and_caps(spark):
    rows = [(i, "a", 10) for i in range(3000)] + [(10000 + i, "b", 7) for i in range(400)] + [(20000 + i, "c", 3) for i in range(100)] + [(1, "z", 5), (2, None, 5), (3, "a", 0), (4, "a", None)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.28, 2), ("c", 0.02, 3), ("e", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = X.mix(counts, targets, policy="exact", block_tokens=2000)
    got, rep = chosen.collect(), {r["source"]: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "e"} and {r["source"] for r in got} <= {"a", "b", "c"}
    assert len({r["doc_id"] for r in got}) == len(got)
    assert all(1 <= r["copies"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in got)
    for s, t in (("a", 0.7), ("b", 0.28), ("c", 0.02)):
        assert abs(rep[s]["reached_share"] - t) < 0.002
    assert rep["e"]["selected_tokens"] == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, X.mix(counts.repartition(3), targets, policy="exact", block_tokens=2000)[0].collect()))


def test_empty(spark):
    counts = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 1)], "source string, target_share double, max_repeats int")
    chosen, report = X.mix(counts, targets)
    assert chosen.count() == 0 and report.collect()[0]["selected_tokens"] == 0
    assert X.mix(counts, targets.limit(0))[1].count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, " Lab_Mail ", "hello world"), (2, None, None), (3, "a", ""), (4, "b", "<|endoftext|>"), (5, "c", "x" * 20000)], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in X.token_counts(df, "doc_id", "text", X.source_name(F.col("source")), vocabulary=VOCABULARY).collect()}
    assert got[1]["n_tokens"] == 2 and got[1]["source"] == "lab-mail" and got[2]["n_tokens"] == 0 and got[2]["source"] is None and got[3]["n_tokens"] == 0 and got[4]["n_tokens"] > 1 and got[5]["n_tokens"] > 100


def test_cap_of_zero_and_entropy_reach_the_mixture(spark):
    s, total, _ = X.plan([X.Source("a", 1000, 0.5, 1), X.Source("b", 500, 0.5, 0)])
    assert total == 1000 and [x.budget for x in s] == [1000, 0]
    counts = spark.createDataFrame([(i, "a", 10) for i in range(900)] + [(1000 + i, "b", 10) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.15, 9), ("b", 0.85, 9)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in X.mix(counts, targets, total_tokens=8000.0, base="equal", entropy_of_targets=True, block_tokens=500)[1].collect()}
    assert abs(rep["a"]["reached_share"] - 0.85) < 0.01 and 0 < rep["a"]["exponent"] < 1


def test_a_source_in_many_blocks_meets_its_budget(spark):
    counts = spark.createDataFrame([(i, "a", i % 50) for i in range(5000)] + [(9000 + i, "b", 30) for i in range(100)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in X.mix(counts, targets, block_tokens=300)[1].collect()}
    total = sum(r["available_tokens"] for r in rep.values())
    assert abs(rep["b"]["repeats"] - 4) < 0.05
    assert all(abs(r["selected_tokens"] - r["weight"] * total) <= 50 for r in rep.values())
