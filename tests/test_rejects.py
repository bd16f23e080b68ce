from strandline.operators.rejects import parsed_lines, rejected_rows, valid_rows

GOOD = 'c1\tsrc\texon\t1\t5\t.\t+\t.\tgene_id "g1"; n 2;'


def verdicts(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, line string")
    out = {r["line_id"]: r["_reason"] or "ok" for r in parsed_lines(df).collect()}
    return [out.get(i) for i in range(len(lines))]


def swap(i, value):
    f = GOOD.split("\t")
    f[i] = value
    return "\t".join(f)


def test_reasons(spark):
    cases = {
        GOOD: "ok", GOOD + "\r": "ok", GOOD + "\r\r": "invalid_attributes", "#x": None, "": None, " \t ": None, None: None, "\r": None, " " + GOOD: "ok",
        "a\tb": "column_count", GOOD + "\tx": "column_count", swap(0, ""): "empty_field", swap(2, ""): "empty_field", swap(0, "."): "ok", swap(1, "#"): "ok", swap(3, "."): "invalid_start", swap(4, "."): "invalid_end", swap(8, "."): "invalid_attributes",
        swap(3, "0"): "invalid_start", swap(3, "+1"): "invalid_start", swap(3, "007"): "start_after_end", swap(3, "6"): "start_after_end", swap(4, "2147483648"): "invalid_end", swap(4, "2147483647"): "ok", swap(4, " 5"): "invalid_end", swap(4, "0" * 40 + "5"): "ok",
        swap(5, "NaN"): "invalid_score", swap(5, "1e5"): "ok", swap(5, "-.5"): "invalid_score", swap(5, ""): "invalid_score", swap(5, "1e999"): "invalid_score", swap(5, "-1E+400"): "invalid_score", swap(5, "1e308"): "ok", swap(5, "1e-999"): "ok", swap(5, "1d"): "invalid_score", swap(5, "Infinity"): "invalid_score", swap(3, "\u0663"): "invalid_start", swap(6, "?"): "invalid_strand", swap(7, "3"): "invalid_frame",
        swap(8, 'a "x'): "broken_quoting", swap(8, 'a "x";; b 1'): "invalid_attributes", swap(8, 'a "x;y"'): "ok", swap(8, r'a "x\"y\\"'): "ok", swap(8, r'a "x\ny"'): "invalid_attributes", swap(8, "a"): "invalid_attributes", swap(8, ""): "invalid_attributes", swap(8, ' a "" ; '): "ok", swap(8, 'a-b "x"'): "invalid_attributes", swap(8, 'a x"y'): "broken_quoting",
    }
    assert dict(zip(cases, verdicts(spark, list(cases)))) == cases


def test_very_long_texts(spark):
    many = "; ".join(f'k{i} "v{i}"' for i in range(20000))
    escaped = 'k "' + '\\"' * 50000 + '"'
    assert verdicts(spark, [swap(8, many), swap(8, escaped), swap(8, many + " !"), swap(8, "k " + "x" * 200000), swap(8, escaped[:-1])]) == ["ok", "ok", "invalid_attributes", "ok", "broken_quoting"]


def test_rows_and_rejects(spark):
    df = spark.createDataFrame([(1, GOOD + "\r", 9), (2, "bad", 8), (3, GOOD, 7), (4, swap(5, "2.5"), 6)], "line_id int, line string, _raw int")
    rows = valid_rows(df, ["line_id"]).orderBy("line_id").collect()
    assert [r["line_id"] for r in rows] == [1, 3, 4] and rows[2]["score"] == 2.5 and rows[0]["frame"] is None and rows[0]["strand"] == "+" and (rows[0]["start"], rows[0]["end"]) == (1, 5)
    dotted = valid_rows(spark.createDataFrame([(1, "." + GOOD[2:])], "line_id int, line string"), []).first()
    assert dotted["seqname"] == "." and dotted["attributes"] == GOOD.split("\t")[8]
    assert [tuple(r) for r in rejected_rows(df, ["line_id"]).collect()] == [(2, "column_count", "bad")]
    assert rejected_rows(df.limit(0), ["line_id"]).collect() == []
