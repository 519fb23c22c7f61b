"""Tables leave no shuffle files behind."""

from pyspark.sql import functions as F

from tessera.llm import tables


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(tables.CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    made = tables.table(df.join(spark.range(10).toDF("k").repartition(3, "k").hint("merge"), "k"))
    assert not shuffle_files(spark) - before
    assert {r.n for r in made.collect()} == {100} and spark.conf.get(tables.CLEANUP, None) == setting
