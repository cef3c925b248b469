from corvane.operators.skew import hot_keys, salted_join
from corvane.storage import materialise, shared_dir
from pyspark.sql import functions as F


def test_hot_keys(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    assert [k for k, _ in hot_keys(df, "k", hot_rows=1000)] == [7]
    assert hot_keys(df, "k", hot_rows=5000) == []
    assert hot_keys(df.limit(0), "k", hot_rows=1) == []


def test_salted_join_equals_join(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("k"))
    dims = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (99, "d")], "k long, v string")
    for how in ("left", "inner"):
        plain = sorted(map(str, facts.join(dims, "k", how).select("id", "k", "v").collect()))
        for hot_rows in (100, 10**9):
            salted = salted_join(facts, dims, "k", F.col("id"), how=how, hot_rows=hot_rows).select("id", "k", "v")
            assert sorted(map(str, salted.collect())) == plain


def test_hot_rows_are_spread(spark):
    facts = spark.range(4000).select("id", F.lit(7).cast("long").alias("k"))
    dims = spark.createDataFrame([(7, "a")], "k long, v string").hint("merge")
    joined = salted_join(facts.hint("merge"), dims, "k", F.col("id"), hot_rows=500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1


def test_written_tables_are_in_the_shared_folder(spark):
    df = materialise(spark.range(3).toDF("x"), "test")
    assert df.inputFiles()[0].replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/"))
    assert sorted(r["x"] for r in df.collect()) == [0, 1, 2]
