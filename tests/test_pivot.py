import datetime as dt

from pyspark.sql import Row

from strandline.operators.pivot import Attribute, attributes, pivot_blocks, unusable_cells

T = [dt.datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "e bigint, k string, v string, at timestamp, _e string, record_kind int"
DECLARED = [Attribute("I"), Attribute("N", "1", "Integer"), Attribute("F", "1", "Float"), Attribute("C", "1", "Character"), Attribute("B", "0", "Flag"), Attribute("L", ".", "Integer"), Attribute("G", "A", "Float")]


def wide(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r["e"]: r.asDict() for r in pivot_blocks(df, DECLARED, entity="e", attribute="k", value="v", order="at", **how).collect()}


def test_types_blanks_and_invalid_values(spark):
    got = wide(
        spark,
        [
            (1, "N", " 42 ", T[0]), (1, "F", "-1.5e3", T[0]), (1, "C", "x", T[0]), (1, "B", "", T[0]), (1, "L", "1,.,3", T[0]), (1, "G", ".5", T[0]),
            (2, "N", "2147483648", T[0]), (2, "F", "1.", T[0]), (2, "C", "xy", T[0]), (2, "B", "1", T[0]), (2, "L", "1,,2", T[0]), (2, "G", "0.5,.", T[0]),
            (3, "N", ".", T[0]), (3, "F", None, T[0]), (3, "B", None, T[0]), (3, "I", "any thing", T[0]),
        ],
    )
    assert (got[1]["N"], got[1]["F"], got[1]["C"], got[1]["B"], got[1]["L"], got[1]["_invalid"]) == (42, -1500.0, "x", True, [1, None, 3], ["G"])
    assert got[2]["_invalid"] == ["B", "C", "F", "L", "N"] and got[2]["G"] == [0.5, None]
    assert got[3]["_invalid"] == [] and got[3]["N"] is None and got[3]["B"] is True and got[3]["I"] == "any thing"


def test_latest_valid_value_wins_and_ties_are_settled(spark):
    got = wide(spark, [(1, "N", "1", T[0]), (1, "N", "2", T[3]), (1, "N", "x", T[5]), (2, "N", "7", T[1]), (2, "N", "9", T[1]), (2, "N", "9", T[1]), (3, "N", "5", None), (3, "N", "4", T[0])])
    assert (got[1]["N"], got[2]["N"], got[3]["N"]) == (2, 9, 4) and not got[1]["_invalid"]


def test_nulls_undeclared_keys_and_many_blocks(spark):
    rows = [(None, "N", "1", T[0]), (1, None, "1", T[0]), (4, "ZZ", "a", T[0]), (4, "ZZ", "b", T[1]), (4, "n", "1", T[0]), (5, "ZZ", None, T[0]), (6, "F", "1" * 5000, T[0])]
    got = wide(spark, rows, block_size=2)
    assert set(got) == {4, 5, 6}
    assert got[4]["_extras"] == {"ZZ": "b", "n": "1"} and got[5]["_extras"] is None and got[4]["N"] is None
    assert wide(spark, rows, block_size=64) == got


def plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_scan_and_one_exchange_by_entity(spark, tmp_path):
    spark.createDataFrame([(1, "N", "1", T[0], "x", 1)], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for size in (1, 2, 64):
        text = plan(spark, pivot_blocks(df, DECLARED, entity="e", attribute="k", value="v", block_size=size))
        assert text.count("Scan parquet") == 1
        # one by entity and key for the cells, one by entity; nothing for the blocks
        assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in text


def test_a_flag_without_text_is_set(spark):
    got = wide(spark, [(1, "B", None, T[0]), (2, "B", "x", T[0]), (2, "B", "", T[0]), (3, "N", "1", T[0])])
    assert (got[1]["B"], got[2]["B"], got[3]["B"]) == (True, True, None) and got[2]["_invalid"] == []


def test_an_entity_with_most_of_the_rows(spark):
    rows = [(1, "N", str(i), T[i % 8]) for i in range(2000)] + [(1, f"Z{i}", "a", T[0]) for i in range(300)] + [(2, "N", "5", T[0])]
    got = wide(spark, rows)
    last = max((T[i % 8], str(i)) for i in range(2000))
    assert got[1]["N"] == int(last[1]) and len(got[1]["_extras"]) == 300 and got[2]["N"] == 5


def test_empty_table_definitions_and_unusable_cells(spark):
    assert wide(spark, []) == {}
    defs = spark.createDataFrame([("data", "N", "1", "Integer"), ("data", "N", "1", "Integer"), ("info", "Q", None, None), ("data", None, "1", "Float")], "record_kind string, field_key string, value_count string, value_type string")
    assert attributes(defs, "data") == [Attribute("N", "1", "Integer")] and attributes(defs, "info") == [Attribute("Q", "1", "String")]
    w = pivot_blocks(spark.createDataFrame([(1, "N", "x", T[0], "", 0)], SCHEMA), DECLARED, entity="e", attribute="k", value="v")
    assert unusable_cells(w, "e", "data").collect() == [Row(record_kind="data", record_id=1, field_key="N")]
    none = pivot_blocks(spark.createDataFrame([(1, "N", "x", T[0], "", 0)], SCHEMA), [], entity="e", attribute="k", value="v").collect()
    assert none[0]["_extras"] == {"N": "x"} and none[0]["_invalid"] == []
