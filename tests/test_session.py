from strandline.session import checkpointed, scratch, spread, within


def test_small_scans_are_spread_and_large_ones_left_alone(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    assert df.rdd.getNumPartitions() == 1 and spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df).count() == 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        split = spark.read.parquet(str(tmp_path / "a"))
        assert spread(split) is split
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bounds_and_lineage(spark):
    df = spark.range(10)
    assert within(df, 10) and not within(df, 9) and within(df.limit(0), 0)
    assert sorted(r[0] for r in checkpointed(df).collect()) == list(range(10))
    assert scratch(spark, "x") != scratch(spark, "x")
