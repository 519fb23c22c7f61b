"""Shared tables, prefix sums and connected components for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.shared import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write in here deletes its shuffle files when it ends; otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str = "part", compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `table` made and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, a table of a few short columns, marked for broadcast if it has at most so many rows; beyond that it is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names, one for each of names, that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    return [next(c for c in (f"_{n}{i or ''}" for i in range(len(taken) + 1)) if c.lower() not in taken) for n in names]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_offset(counts: DataFrame, order: str, n: str, by: list[str] | None = None, width: int = 1024) -> DataFrame:
    """Adds `before`: the sum of n over all rows of smaller `order` (a long from 0), within each group of `by`.

    Two levels, so that no task sorts more than `width` rows of a block or one row for each block.
    """
    by = by or []
    block = F.floor(F.col(order) / width).alias("_block")
    blocks = counts.groupBy(*by, block).agg(F.sum(n).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_block", block).withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return rows.join(blocks, [*by, "_block"]).withColumn("before", (F.col("_start") + F.col("_inside")).cast("long")).drop("_block", "_start", "_inside")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node of the component.

    Every round hangs each node below its smallest neighbour, jumps to the tops of the trees that this makes (doubling the
    jump each time) and contracts the links to those tops, which at least halves the nodes that still have links. So n
    nodes take at most log2(n) rounds of at most log2(n) jumps. Nothing but "is anything left?" reaches the driver. Nodes without links don't occur in the result.
    """
    e = table(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    found = None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "up")
        deeper = True
        while deeper:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("_top"))
            jumped = table(up.join(above, "root").select("node", F.col("_top").alias("root"), (F.col("_top") != F.col("root")).alias("_moved")), "up")
            deeper = not jumped.where("_moved").isEmpty()
            up = jumped.drop("_moved")
        if found is None:
            found = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("_higher"))
            found = table(found.join(step, "root", "left").select("node", F.coalesce("_higher", "root").alias("root")), "found")
        e = e.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        e = table(e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if found is None:
        found = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) of what root, an answer of `components`, knows already and of new links (a, b) together."""
    r = root.select("node", "root")
    ends = links.select("a", "b").join(r.toDF("a", "xa"), "a", "left").join(r.toDF("b", "xb"), "b", "left")
    up = components(ends.select(F.coalesce("xa", "a").alias("a"), F.coalesce("xb", "b").alias("b")))
    old = r.join(up.toDF("root", "_top"), "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return table(old.unionByName(up.join(r.select("node"), "node", "left_anti")), "found")
