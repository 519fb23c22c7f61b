"""Usage summaries over an event log (day, surface, view, event, session)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since(events: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """Events of the last days, day -n included; as_of defaults to the log's last day, never to the clock."""
    if as_of is not None:
        return events.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))
    last = events.agg(F.date_sub(F.max("day"), days).alias("_from"))
    return events.crossJoin(F.broadcast(last)).where("day >= _from").drop("_from")


def views(events: DataFrame) -> DataFrame:
    return events.where("event = 'view'")


def usage_totals(events: DataFrame, empty_counts: bool = True) -> DataFrame:
    """views and visitors of view events; an empty session counts as one visitor unless empty_counts is False."""
    who = F.col("session") if empty_counts else F.nullif(F.col("session"), F.lit(""))
    return views(events).agg(F.count("*").alias("views"), F.countDistinct(who).alias("visitors"))


def usage_by(events: DataFrame, column: str) -> DataFrame:
    """views and visitors of view events for each value of surface, day or the like."""
    return views(events).groupBy(column).agg(F.count("*").alias("views"), F.countDistinct("session").alias("visitors"))


def usage_by_view(events: DataFrame, top: int = 15) -> DataFrame:
    """The most seen pages as `surface · view`; views without a name are left out."""
    label = F.concat_ws(" · ", "surface", "view").alias("label")
    return views(events).where("view <> ''").groupBy(label).agg(F.count("*").alias("views")).orderBy(F.desc("views"), "label").limit(top)


def usage_by_country(events: DataFrame, top: int = 15) -> DataFrame:
    """Visitors of each known country, over all events."""
    return events.where("country <> ''").groupBy("country").agg(F.countDistinct("session").alias("visitors")).orderBy(F.desc("visitors"), "country").limit(top)


def usage_by_event(events: DataFrame, top: int = 15) -> DataFrame:
    """How often each event other than a view occurred."""
    return events.where("event <> 'view'").groupBy("event").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event").limit(top)


def scans(events: DataFrame) -> DataFrame:
    """Scans of printed codes, with the code."""
    return events.where("surface = 'qr' AND event = 'qr:scan'").withColumn("code", F.col("view")).withColumn("who", F.nullif(F.col("session"), F.lit("")))


def code_stats(events: DataFrame, codes: DataFrame, days: int) -> DataFrame:
    """For each code: scans, people, first and last scan in the window, scans of all time; 0 for codes never scanned."""
    last = events.agg(F.date_sub(F.max("day"), days).alias("_from"))
    marked = scans(events).crossJoin(F.broadcast(last)).withColumn("_in", F.col("day") >= F.col("_from"))
    inside = lambda c: F.when(F.col("_in"), F.col(c))
    own = marked.groupBy("code").agg(F.count_if("_in").alias("scans"), F.countDistinct(inside("who")).alias("people"), F.min(inside("ts")).alias("first"), F.max(inside("ts")).alias("last"), F.count("*").alias("all_time"))
    return codes.join(own, "code", "left").fillna(0, ["scans", "people", "all_time"])


def code_stats_by_day(events: DataFrame, codes: DataFrame, days: int) -> DataFrame:
    """code, day, scans, people of the days of the window that have scans."""
    own = scans(since(events, days)).groupBy("code", "day").agg(F.count("*").alias("scans"), F.countDistinct("who").alias("people"))
    return own.join(codes, "code", "left_semi")


def retain(events: DataFrame, days: int = 400) -> DataFrame:
    """The log without days older than `days` before its last."""
    return since(events, days)
