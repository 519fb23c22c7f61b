"""Queries that run as streams over all events that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import usage as U
from tessera.plans.base import Tables, query
from tessera.streaming import usage as S


def _events(spark, sf_dir):
    return S.arrived(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, CAST(ts AS DATE) AS day, event_type, substr(sha256('salt|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || user_id), 1, 16) AS visitor FROM events")
def stream_ingest(spark, sf_dir):
    return S.landed(S.ingested(_events(spark, sf_dir), "salt"), "ingested").select("event_id", "day", "event_type", "visitor")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events), w AS (SELECT day + CAST(k AS INT) AS ends, event_type FROM d, range(1, 8) t(k)) SELECT strftime(ends, '%Y-%m-%d') AS ends, event_type, count(*) AS n FROM w WHERE CAST(ends AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2")
def stream_usage_sliding(spark, sf_dir):
    out = S.landed(S.sliding_usage(_events(spark, sf_dir), "7 days", "1 day"), "sliding")
    return out.select(F.date_format("ends", "yyyy-MM-dd").alias("ends"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT user_id, run, count(*) AS n, max(ts) AS last FROM r GROUP BY 1, 2) SELECT user_id, n FROM s WHERE last + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_sessions(spark, sf_dir):
    return S.landed(S.visitor_sessions(_events(spark, sf_dir), "12 hours"), "sessions").select("user_id", "n")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_latest_per_source(spark, sf_dir):
    return S.latest_per_source(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT c_custkey FROM customer JOIN l ON user_id = c_custkey WHERE t = 'click'")
def stream_publish_feed(spark, sf_dir):
    moves = _events(spark, sf_dir).select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "click", "approved").otherwise("rejected").alias("status"), F.col("event_id").alias("seq"))
    return S.publish_feed(moves, Tables(spark, sf_dir)["customer"], "c_custkey").select("c_custkey")


_MOVES = "m AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'no' WHEN event_id % 2 = 0 THEN 'host_yes' ELSE 'admin_yes' END AS move FROM events), h AS (SELECT id, min(seq) FILTER (WHERE move = 'host_yes') AS h, min(seq) FILTER (WHERE move = 'no') AS n FROM m GROUP BY 1), a AS (SELECT h.id, h, n, min(seq) FILTER (WHERE move = 'admin_yes' AND seq > h) AS a FROM h JOIN m ON m.id = h.id GROUP BY 1, 2, 3)"


@query(f"WITH {_MOVES} SELECT id, CASE WHEN a IS NOT NULL AND (n IS NULL OR a < n) THEN 'approved' WHEN n IS NOT NULL THEN 'rejected' WHEN h IS NOT NULL THEN 'host_approved' ELSE 'pending_host' END AS status FROM a")
def stream_registrations(spark, sf_dir):
    move = F.when(F.col("event_id") % 7 == 0, "no").when(F.col("event_id") % 2 == 0, "host_yes").otherwise("admin_yes")
    return S.registration_state(_events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), move.alias("move")))


@query("SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 3")
def retention(spark, sf_dir):
    return U.retain(Tables(spark, sf_dir).usage, 3).select("id")


@query()
def stream_vote_state(spark, sf_dir):
    toggles = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit(1).alias("season_id"), (F.col("user_id") % 40).cast("string").alias("voter_uid"), F.floor(F.col("value")).cast("long").alias("entry_id"))
    with S.rocksdb(spark):
        return S.landed(S.vote_state(toggles, 5), "votes")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events) SELECT day, count(*) AS n FROM d WHERE CAST(day + 4 AS TIMESTAMP) > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def stream_kept_days(spark, sf_dir):
    """Events of the days that retention keeps, as a stream with state that ends by timers."""
    return S.kept_days(_events(spark, sf_dir), 3, S._folder(spark, "kept"))
