"""Column profiles, histograms and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Places on the map, and parts of names of identifiers.
PLACES = {"lat", "lng", "latitude", "longitude"}
IDS = ("_id", "timestamp", "geo_precision")


def excluded(name: str) -> bool:
    """Identifiers and coordinates aren't charted."""
    low = name.lower()
    return low in PLACES or low == "id" or any(part in low for part in IDS)


def profile_columns(df: DataFrame) -> DataFrame:
    """column, n_filled, n_numeric, n_values, n_numbers, kind for each column that isn't an identifier or coordinate.

    numeric: over 0.6 of the filled cells are numbers, with over 3 distinct ones. categorical: 2 to 120 values, under 0.9 of
    all rows. empty: nothing filled. Else other. Cells are stacked and counted by (column, value), then by column.
    """
    names = [c for c in df.columns if not excluded(c)]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in names])).alias("_c")).select("_c.*")
    values = cells.groupBy("column", F.nullif("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    values = values.withColumn("x", F.expr("try_cast(value AS double)"))
    filled, number = F.col("value").isNotNull(), F.col("x").isNotNull()
    by_number = values.groupBy("column", "x").agg(F.sum("n").alias("n"), F.sum(F.when(filled, F.col("n"))).alias("f"), F.count("value").alias("v"))
    out = by_number.groupBy("column").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n_filled"), F.coalesce(F.sum(F.when(number, F.col("n"))), F.lit(0)).alias("n_numeric"), F.sum("v").alias("n_values"), F.count("x").alias("n_numbers"), F.sum("n").alias("_rows"))
    numeric = (F.col("n_numeric") > 0.6 * F.col("n_filled")) & (F.col("n_numbers") > 3)
    kind = F.when(F.col("n_filled") == 0, "empty").when(numeric, "numeric").when(F.col("n_values").between(2, 120) & (F.col("n_values") < 0.9 * F.col("_rows")), "categorical").otherwise("other")
    return out.withColumn("kind", kind).drop("_rows")


def quantiles(df: DataFrame, col: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """One row with q0, q1, …: exact quantiles, linear between neighbours (null for no values).

    Values are counted by bin and only those of the few bins that hold the wanted ranks are put in order, by value.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    span = F.broadcast(x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total")))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    counted = x.crossJoin(span).groupBy(at.alias("bin"), "x", "total").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("bin", "total").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.floor(F.lit(p) * (F.col("total") - 1)) + up).alias("rank"), (F.lit(p) * (F.col("total") - 1)).alias("exact")) for i, p in enumerate(shares) for up in (0, 1)])
    wanted = sizes.withColumn("w", F.explode(ranks)).where("w.rank >= before AND w.rank < before + n").select("bin", "before", "w.*")
    inside = counted.join(F.broadcast(wanted.select("bin", "before").distinct()), "bin")
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("x")))
    hit = inside.drop("before").join(F.broadcast(wanted), "bin").where("rank < upto AND rank >= upto - n").select("i", "up", "x", (F.col("exact") - F.floor("exact")).alias("part"))
    value = lambda i: F.max(F.when((F.col("i") == i) & (F.col("up") == 0), F.col("x"))) + F.coalesce(F.max(F.when((F.col("i") == i) & (F.col("up") == 1), F.col("x"))) - F.max(F.when((F.col("i") == i) & (F.col("up") == 0), F.col("x"))), F.lit(0.0)) * F.max(F.when(F.col("i") == i, F.col("part")))
    return hit.agg(*[value(i).alias(f"q{i}") for i in range(len(shares))])


def value_counts(df: DataFrame, col: str, n: int = 25) -> DataFrame:
    text = F.trim(F.col(col).cast("string"))
    return df.select(text.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def trimmed_histogram(df: DataFrame, col: str, bins: int = 30, trim: float = 0.02) -> DataFrame:
    """bin, low, high, n: equal bins between two percentiles; values outside them are left out."""
    edges = quantiles(df, col, [trim, 1 - trim]).toDF("lo", "hi")
    inside = df.select(F.col(col).cast("double").alias("x")).crossJoin(F.broadcast(edges)).where("(x BETWEEN lo AND hi) OR hi <= lo")
    width = (F.col("hi") - F.col("lo")) / bins
    placed = inside.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int"))
    out = placed.groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("high"), "n")


def year_like(df: DataFrame, col: str) -> bool:
    """Whether over 0.7 of a column's numbers lie between 1000 and 2100."""
    x = F.expr(f"try_cast(`{col}` AS double)")
    row = df.agg(F.count(x).alias("n"), F.count_if(x.between(1000, 2100)).alias("years")).first()
    return row["years"] > 0.7 * row["n"]


def histogram(df: DataFrame, col: str, as_of: int, bins: int = 30) -> DataFrame:
    """bin, low, high, n: decades of a column of years, else equal bins of its numbers without the outer 2 %."""
    numbers = df.select(F.expr(f"try_cast(`{col}` AS double)").alias("x"))
    if not year_like(df, col):
        return trimmed_histogram(numbers, "x", bins)
    decades = decade_histogram(numbers.select(F.col("x").cast("int").alias("x")), "x", as_of)
    return decades.select(F.col("decade").alias("bin"), F.col("decade").cast("double").alias("low"), (F.col("decade") + 10).cast("double").alias("high"), "n")


def decade_histogram(df: DataFrame, col: str, as_of: int) -> DataFrame:
    """decade, n of the years from 1850 to as_of."""
    year = F.col(col).try_cast("int")
    return df.where(year.between(1850, as_of)).groupBy((F.floor(year / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def group_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: the options of each facet with their counts."""
    each = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL AND trim(value) <> ''").select(F.lit(c).alias("facet"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, each)


def facet_columns(profile: DataFrame, preferred: list[str], most: int = 3) -> DataFrame:
    """The categorical columns to filter by: those with a preferred word first, then those with the fewest values."""
    rank = F.coalesce(*[F.when(F.contains(F.lower("column"), F.lit(w)), i) for i, w in enumerate(preferred)], F.lit(len(preferred)))
    return profile.where("kind = 'categorical'").orderBy(rank, "n_values", "column").limit(most).select("column", "n_values")
