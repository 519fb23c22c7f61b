"""Usage events as streams: windowed counts and first sightings; each runs over what has arrived and ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import visitor_hash
from tessera.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def arrived(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that match path; times without zone are taken as UTC, as event times need a zone."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    plain = [f.name for f in stream.schema if f.dataType.typeName() == "timestamp_ntz"]
    utc = lambda c: F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})"))
    return stream.withColumns({c: utc(c) for c in plain})


def landed(stream: DataFrame, name: str) -> DataFrame:
    """An append-mode stream, run over all that has arrived into Parquet, and read back."""
    spark = stream.sparkSession
    at = _folder(spark, name)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", at + "/state").start(at + "/rows", format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(at + "/rows")


def daily_usage(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """day (UTC), event_type, n of each day that the watermark has passed."""
    days = stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.date_from_unix_date((F.unix_seconds("window.start") / 86400).cast("int")).alias("day"), "event_type", "n")


def first_seen(stream: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """The keys, each once while the watermark remembers it."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys).select(*keys)


def ingested(stream: DataFrame, salt: str) -> DataFrame:
    """Events with their day (UTC) and a visitor hash that changes from day to day; texts are cut to 60 characters."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))
    return stream.withColumn("day", day).withColumn("event_type", F.left("event_type", F.lit(60))).withColumn("visitor", visitor_hash(F.col("day"), F.col("user_id"), salt))


def sliding_usage(stream: DataFrame, window: str, slide: str, watermark: str = "2 days") -> DataFrame:
    """ends (of the window), event_type, n, visitors (approximate) of each window that the watermark has passed."""
    sums = stream.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("visitors"))
    return sums.select(F.col("window.end").alias("ends"), "event_type", "n", "visitors")


def visitor_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """user_id, starts, n: runs of a visitor's events with no gap longer than `gap`."""
    runs = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("session_window.start").alias("starts"), "n")


class _Votes(StatefulProcessor):
    """A voter's standing votes in a season: a toggle takes a vote back or casts one, up to the cap."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing = handle.getMapState("standing", "entry_id long", "id long")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        n = self.count.get()[0] if self.count.exists() else 0
        toggles = pd.concat(list(rows))  # a busy voter's rows come in several chunks
        for id_, entry in toggles.sort_values("id")[["id", "entry_id"]].itertuples(index=False):
            if self.standing.containsKey((int(entry),)):
                self.standing.removeKey((int(entry),))
                n, change = n - 1, "removed"
            elif n < self.cap:
                self.standing.updateValue((int(entry),), (int(id_),))
                n, change = n + 1, "cast"
            else:
                change = "over_cap"
            out.append((int(id_), int(key[0]), str(key[1]), int(entry), change))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["id", "season_id", "voter_uid", "entry_id", "change"])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with maps and timers needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def vote_state(stream: DataFrame, cap: int) -> DataFrame:
    """id, season_id, voter_uid, entry_id, change (cast, removed, over_cap) of each toggle, in order of id within what arrives
    together. State is kept by voter and season: a map of standing votes, at most `cap`. Start it inside `rocksdb`. A voter's toggles of
    one micro-batch are in memory together; maxFilesPerTrigger on the source bounds them."""
    own = stream.select("id", F.col("season_id").cast("long").alias("season_id"), "voter_uid", "entry_id").groupBy("season_id", "voter_uid")
    return own.transformWithStateInPandas(_Votes(cap), "id long, season_id long, voter_uid string, entry_id long, change string", "Append", "none")


class _Days(StatefulProcessor):
    """The count of a day's events, until the watermark has left the day `keep` days behind."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, day = sum(len(pdf) for pdf in rows), key[0]
        ends = (day - date(1970, 1, 1)).days + 1 + self.keep
        if ends * 86_400_000 <= timerValues.getCurrentWatermarkInMs():
            return
        n += self.count.get()[0] if self.count.exists() else 0
        self.count.update((n,))
        self.handle.registerTimer(ends * 86_400_000)
        yield pd.DataFrame([(day, n)], columns=["day", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield pd.DataFrame([(key[0], 0)], columns=["day", "n"])

    def close(self) -> None:
        pass


def kept_days(stream: DataFrame, keep: int, at: str, watermark: str = "1 day") -> DataFrame:
    """day (UTC), n of the days with events that the watermark has not left `keep` days behind, after all that has arrived at any call.

    State lives below `at` and goes on with the next call; a day's state is deleted by its timer. Events later than the watermark allows,
    those of days already dropped among them, change nothing.
    """
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int")).alias("day")
    counted = stream.select("ts", day).withWatermark("ts", watermark).groupBy("day")
    with rocksdb(stream.sparkSession):
        changes = counted.transformWithStateInPandas(_Days(keep), "day date, n long", "Update", "eventTime")
        return folded(changes, "days", ["day"], None, at).where("n > 0")


def _versions(spark: SparkSession, folder: str) -> dict[int, object]:
    """The numbered tables below a folder, and their paths; Spark marks whole ones with _SUCCESS."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    whole = [s.getPath() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return {int(p.getName()): p for p in whole}


def _put(spark: SparkSession, df: DataFrame, folder: str, n: int) -> None:
    """df as table n; those before n - 1 are deleted, as a batch that is run again reads n - 1."""
    df.write.mode("overwrite").parquet(f"{folder}/{n}")
    for old, path in _versions(spark, folder).items():
        if old < n - 1:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _before(spark: SparkSession, folder: str, n: int, schema) -> DataFrame | None:
    """The newest table before n: batches without rows make none."""
    older = [v for v in _versions(spark, folder) if v < n]
    return spark.read.schema(schema).parquet(f"{folder}/{max(older)}") if older else None


def merged(stream: DataFrame, at: str, schema, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The table that merge(table so far or None, micro-batch) makes of all that has arrived, at this call and at those before it with the
    same `at`, where the stream's progress and two tables are kept."""
    spark = stream.sparkSession
    folder = f"{at}/rows"
    step = lambda batch, n: _put(batch.sparkSession, merge(_before(batch.sparkSession, folder, n, schema), batch), folder, n)
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(step).start().awaitTermination()
    return _before(spark, folder, 1 << 62, schema) or spark.createDataFrame([], schema)


def folded(stream: DataFrame, name: str, keys: list[str], order: str | None, at: str | None = None) -> DataFrame:
    """The last row of each key after all that has arrived: by `order`, or the later batch's without one. With `at` a later call goes on
    where the last one ended."""
    where, last = at or _folder(stream.sparkSession, name), [F.desc(order)] if order else []

    def merge(table: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch.withColumn("_new", F.lit(1))
        both = table.withColumn("_new", F.lit(0)).unionByName(both) if table is not None else both
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*last, F.desc("_new")))
        return both.withColumn("_n", first).where("_n = 1").drop("_n", "_new")

    return merged(stream, where, stream.schema, merge, "update" if order is None else "append")


def latest_per_source(stream: DataFrame, source: str, order: str, at: str | None = None) -> DataFrame:
    """The newest value of each source: what a page shows while a source is silent."""
    return folded(stream, "latest", [source], order, at)


def publish_feed(decisions: DataFrame, base: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """The rows of base whose last decision (a stream of key, status, seq) is to approve them."""
    last = folded(decisions, "decisions", [key], "seq", at)
    return base.join(last.where("status = 'approved'").select(key), key, "left_semi")


def registration_state(moves: DataFrame, at: str | None = None) -> DataFrame:
    """id, status of registrations after a stream of moves (id, seq, move): host_yes, admin_yes, no.

    A registration waits for the host, then for the admin; moves that don't fit where it stands change nothing.
    """
    schema = f"id {dict(moves.dtypes)['id']}, status string"

    def merge(table: DataFrame | None, batch: DataFrame) -> DataFrame:
        old = table if table is not None else batch.select("id", F.lit("pending_host").alias("status")).limit(0)
        steps = batch.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "move"))), lambda m: m["move"]).alias("moves"))
        start = F.coalesce("status", F.lit("pending_host"))
        to = F.aggregate("moves", start, lambda s, m: F.when(s.isin("approved", "rejected"), s).when(m == "no", "rejected").when((s == "pending_host") & (m == "host_yes"), "host_approved").when((s == "host_approved") & (m == "admin_yes"), "approved").otherwise(s))
        return old.join(steps, "id", "full").select("id", F.when(F.col("moves").isNull(), F.col("status")).otherwise(to).alias("status"))

    return merged(moves, at or _folder(moves.sparkSession, "registrations"), schema, merge)
