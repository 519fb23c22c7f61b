"""Proportional stratified interleaving: shards of equal row counts that all hold the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import load, running_offset, table

#: Rows that a bin of the two distributed rankings holds on average.
BIN = 4096


def _binned_rank(rows: DataFrame, by: list[str], bin_: str, order: list[str], name: str) -> DataFrame:
    """Adds `name`, the 1-based rank within `by` of rows whose order follows their bin and, inside it, `order`.

    Bins are ranked by a window each and offset by the sizes of the bins before, so no task holds a whole group.
    """
    offsets = running_offset(rows.groupBy(*by, bin_).agg(F.count("*").alias("_size")), bin_, "_size", by).select(*by, bin_, "before")
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by, bin_).orderBy(*order)))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, bin_]]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return ranked.alias("r").join(offsets.alias("o"), on, "left").select("r.*", (F.col("o.before") + F.col("_at")).alias(name)).drop("_at")


def interleave(rows: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 17) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (from 0, gapless in each shard) to rows; other columns stay.

    Rows are shuffled by a seeded hash of the key and the row within each stratum; the r-th of n rows has the fractional rank
    (r - 0.5) / n; all rows sorted by it are cut into runs whose lengths differ by one at most. So every shard has each
    stratum in proportion, one row more or less. A null stratum is a stratum, a null key a key; rows that are equal in all are
    told apart by nothing, and any of them may come first. The result depends on the rows alone. Columns named shard or slot
    are replaced, other names don't matter. An empty table stays empty.
    """
    others = [c for c in rows.columns if c not in ("shard", "slot")]
    n = rows.count()
    if not n:
        return rows.select(*others, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bins = -(-n // BIN)
    put = rows.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"), F.xxhash64(*rows.columns).alias("_own"), F.struct(*others).alias("_row"))
    deal = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.col("_own").cast("string")))
    work = put.select("_row", "_key", "_own", F.coalesce("_stratum", F.lit("")).alias("_s"), F.col("_stratum").isNotNull().alias("_known"), deal.alias("_deal"))
    work = work.withColumn("_bin", F.floor(F.conv(F.substring("_deal", 1, 8), 16, 10).cast("double") / 2**32 * bins).cast("long"))
    sizes = work.groupBy("_s", "_known").agg(F.count("*").alias("_n"))
    work = _binned_rank(work, ["_s", "_known"], "_bin", ["_deal", "_key", "_own"], "_rank")
    part = work.join(sizes, ["_s", "_known"]).withColumn("_part", (F.col("_rank") - F.lit(0.5)) / F.col("_n"))
    part = table(part.drop("_bin", "_n", "_rank").withColumn("_bin", F.least(F.floor(F.col("_part") * bins), F.lit(bins - 1)).cast("long")), "ranks")
    order = _binned_rank(part, [], "_bin", ["_part", "_deal", "_s", "_known", "_key", "_own"], "_rank")
    shard = F.floor((F.col("_rank") - 1) * shards / n)
    # The first rank (from 0) of a shard is the smallest whose shard it is.
    start = F.ceil(shard * F.lit(n) / F.lit(shards))
    return order.select(*[F.col("_row")[c].alias(c) for c in others], shard.cast("int").alias("shard"), (F.col("_rank") - 1 - start).cast("long").alias("slot"))


def shard_documents(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """Every document's shard: doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1 and crc 0."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = interleave(table(docs, "sizes"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
