import datetime as dt

from strandline.functions import sql
from strandline.streaming import files, windows


def test_stream_of_files_to_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sam").write_text("@HD\tVN:1.6\nr1\t0\tsq0\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\r\n")
    (tmp_path / "in/b.sam").write_text("r2\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*\nbroken\n")
    got = []
    q = files.write_batches(files.stream_lines(spark, str(tmp_path / "in"), "sam", files_per_trigger=1), lambda df, n: got.extend((r["name"], r["pos"], r["_corrupt"]) for r in df.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    assert sorted(got, key=str) == sorted([("r1", 3, None), ("r2", None, None), ("broken", None, "broken")], key=str)


def test_windows_agree_for_batch_and_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", float(m)) for m in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windows.windowed_counts(df, time="ts", key="k", value="v", width="10 minutes").collect()))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windows.windowed_counts(s, time="ts", key="k", value="v", width="10 minutes", late="1 minute")
    q = out.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from win").collect())) == want and len(want) == 6


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("select cigar_span('5S10M2I3D4N8M') a, cigar_span('*') b, cigar_read_length('5S10M2I') c, reg2bin(1, 1) d, has_flag(4, 4) e, reverse_complement('ACGTN') f, intervals_overlap(1, 5, 5, NULL) g, is_piled(1024) h").collect()[0]
    assert tuple(r) == (25, None, 17, 4681, True, "NACGT", True, False)
