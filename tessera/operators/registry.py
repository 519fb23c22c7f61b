"""Gate, search, pages, edits and counts over registry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _decided(approvals: DataFrame, tbl: str, *status: str) -> DataFrame:
    return approvals.where((F.col("tbl") == tbl) & F.col("status").isin(*status)).select(F.col("row_id").alias("_row_id"))


def gate(df: DataFrame, tbl: str, approvals: DataFrame) -> DataFrame:
    """Only approved rows: what is not decided is not public."""
    return df.join(_decided(approvals, tbl, "approved"), "_row_id", "left_semi")


def gate_include_pending(df: DataFrame, tbl: str, approvals: DataFrame) -> DataFrame:
    return df.join(_decided(approvals, tbl, "rejected"), "_row_id", "left_anti")


def pending(df: DataFrame, tbl: str, approvals: DataFrame, limit: int | None = None) -> DataFrame:
    rows = df.join(_decided(approvals, tbl, "approved", "rejected"), "_row_id", "left_anti")
    return rows if limit is None else rows.orderBy("_row_id").limit(limit)


def gate_counts(df: DataFrame, tbl: str, approvals: DataFrame) -> DataFrame:
    """total, approved, rejected, pending (never below 0) in one row."""
    own = approvals.where(F.col("tbl") == tbl).agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return df.agg(F.count("*").alias("total")).crossJoin(own).withColumn("pending", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("approved") - F.col("rejected")))


def set_status(approvals: DataFrame, tbl: str, ids: DataFrame, status: str) -> DataFrame:
    """approvals with the decision for ids (a column row_id) replaced."""
    new = ids.select(F.lit(tbl).alias("tbl"), "row_id", F.lit(status).alias("status"))
    return approvals.join(new.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti").unionByName(new)


def filter_equals(df: DataFrame, picks: dict[str, object]) -> DataFrame:
    """Rows equal to every pick; names that aren't columns are ignored."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in picks.items() if kv[0] in df.columns], df)


def search(df: DataFrame, q: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with q in any text column, whatever its case; % and _ stand for themselves."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    hits = [F.contains(F.lower(F.col(c)), F.lit(q.lower())) for c in columns]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def search_tokens(df: DataFrame, q: str, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key begins with q, or whose columns together hold every word of q."""
    hay = F.lower(F.concat_ws(" ", *columns))
    every = reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in q.lower().split()] or [F.lit(True)])
    return df.where(F.startswith(F.col(key).cast("string"), F.lit(q)) | every)


def search_records(sources: list[tuple[DataFrame, str, str]], q: str, limit: int) -> DataFrame:
    """gid, label, source_rank: hits of q over (df, id column, label column), earlier sources first, a gid once.

    Inside a source exact labels come first, then the shortest.
    """
    hits = None
    for rank, (df, key, label) in enumerate(sources):
        own = search(df.select(F.col(key).cast("string").alias("gid"), F.col(label).alias("label")), q, ["label"]).withColumn("source_rank", F.lit(rank))
        hits = own if hits is None else hits.unionByName(own)
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("gid").orderBy("source_rank", "label"))).where("_n = 1").drop("_n")
    return first.orderBy("source_rank", F.when(F.lower("label") == q.lower(), 0).otherwise(1), F.length("label"), "label", "gid").limit(limit)


def first_table_with(q: str, tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """tbl, ordinal of the first table with a row whose name column holds q."""
    probes = [search(df, q, [c]).limit(1).select(F.lit(n).alias("tbl"), F.lit(i).alias("ordinal")) for i, (n, df, c) in enumerate(tables)]
    return reduce(DataFrame.unionByName, probes).agg(F.min_by("tbl", "ordinal").alias("tbl"), F.min("ordinal").alias("ordinal")).where("tbl IS NOT NULL")


def page(df: DataFrame, order: str, desc: bool, limit: int, offset: int = 0, tie: str = "_row_id") -> DataFrame:
    """One page, with the count of all rows as `total`."""
    total = df.groupBy().agg(F.count("*").alias("total"))
    by = F.desc_nulls_last(order) if desc else F.asc_nulls_first(order)
    return df.orderBy(by, tie).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def upsert(base: DataFrame, delta: DataFrame, key: str, seq: str) -> DataFrame:
    """base and delta together: delta replaces base whatever their seq; of several delta rows of a key the highest seq wins."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(seq))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def apply_edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change (insert, update, delete), columns that changed; equal rows are left out."""
    cols = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("_a"))
    b = new.select(key, F.struct(*cols).alias("_b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cols]))
    kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.size(changed) > 0, "update")
    return both.select(key, kind.alias("change"), F.when(kind == "update", changed).alias("columns")).where("change IS NOT NULL")


def bulk_set(df: DataFrame, col: str, value: object, cond: Column) -> DataFrame:
    """df with col set where cond holds, and the rows touched marked in `_set`."""
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumn("_set", hit).withColumn(col, F.when(F.col("_set"), F.lit(value)).otherwise(F.col(col)))


def find_replace(df: DataFrame, col: str, find: str, repl: str, substring: bool = True) -> DataFrame:
    return df.withColumn(col, F.replace(col, F.lit(find), F.lit(repl)) if substring else F.when(F.col(col) == find, repl).otherwise(F.col(col)))


def number_repeats(df: DataFrame, base: str, order: list[str], into: str = "unique") -> DataFrame:
    """The first row of a base keeps it, the others get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("_n", n).withColumn(into, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return keep_newest(df, keys, order, 1)


def status_counts(df: DataFrame, by: str, status: str, known: list[str]) -> DataFrame:
    """A row for each `by`, a count for each known status."""
    return df.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in known])


def with_counts(df: DataFrame, details: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Adds a count for each (detail, its key, df's key), 0 where there is none; details are summed before they are joined."""
    for name, (detail, theirs, ours) in details.items():
        n = detail.groupBy(F.col(theirs).alias(f"_{name}")).agg(F.count("*").alias(name))
        df = df.join(n, df[ours] == F.col(f"_{name}"), "left").drop(f"_{name}").fillna(0, [name])
    return df


def priority_union(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, for each key that of the earliest frame which has it."""
    tagged = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")
