"""Queries on workflow transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import games as G
from tessera.operators import workflow as W
from tessera.plans.base import Tables, query

#: Requests: every order, by a customer, for a piece that is its part of a hundred; seasons after 1996 are open.
_REQ = "req AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS season_id, CAST(o_orderkey % 4000 AS VARCHAR) AS object_row_id, CAST(o_custkey AS VARCHAR) AS artist_uid, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS edition_size, o_orderkey % 4 = 0 AS legendary, repeat('x', CAST(o_orderkey % 60 AS INT)) AS legend FROM orders), sea AS (SELECT season_id, CASE WHEN season_id >= 1996 THEN 'open' ELSE 'closed' END AS status FROM seasons WHERE season_id <> 1997), obj AS (SELECT DISTINCT CAST(o_orderkey % 4000 AS VARCHAR) AS object_row_id, CAST(min(o_custkey) OVER (PARTITION BY o_orderkey % 4000) AS VARCHAR) AS owner_uid, o_orderkey % 4000 % 5 <> 0 AS fingerprinted FROM orders WHERE o_orderkey % 4000 % 11 <> 0)"


def _requests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t["orders"]
    piece = (F.col("o_orderkey") % 4000).cast("string")
    req = o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("season_id"), piece.alias("object_row_id"), F.col("o_custkey").cast("string").alias("artist_uid"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("edition_size"), (F.col("o_orderkey") % 4 == 0).alias("legendary"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 60).cast("int")).alias("legend"))
    seasons = t.seasons.where("season_id <> 1997").select("season_id", F.when(F.col("season_id") >= 1996, "open").otherwise("closed").alias("status"))
    objects = o.where("o_orderkey % 4000 % 11 <> 0").groupBy(piece.alias("object_row_id")).agg(F.min("o_custkey").cast("string").alias("owner_uid"), F.max(F.col("o_orderkey") % 4000 % 5 != 0).alias("fingerprinted"))
    return t, req, seasons, objects


#: What stands already: every 41st order, by its customer; every third of those was rejected.
_OLD = "old AS (SELECT CAST(year(o_orderdate) AS INT) AS season_id, CAST(o_orderkey % 4000 AS VARCHAR) AS object_row_id, CAST(o_custkey AS VARCHAR) AS artist_uid, o_orderkey % 2 = 0 AS legendary, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM orders WHERE o_orderkey % 41 = 0)"
#: The fold itself, request by request in each maker's season.
_FOLD = """g AS (SELECT season_id, artist_uid, count(*) AS held, count(*) FILTER (WHERE legendary) AS legends FROM old WHERE status <> 'rejected' GROUP BY 1, 2),
 o AS (SELECT c.*, coalesce(g.held, 0) AS held, coalesce(g.legends, 0) AS legends, row_number() OVER (PARTITION BY season_id, artist_uid ORDER BY id) AS rn FROM asked c LEFT JOIN g USING (season_id, artist_uid)),
 f AS (SELECT season_id, artist_uid, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS l, CAST([] AS VARCHAR[]) AS objects, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason, false AS oe, false AS ol FROM o WHERE rn = 1
  UNION ALL SELECT season_id, artist_uid, rn, CASE WHEN why IS NULL THEN n + 1 ELSE n END, CASE WHEN why IS NULL AND legendary THEN l + 1 ELSE l END, CASE WHEN why IS NULL THEN list_append(objects, object) ELSE objects END, id, why, over_e, over_l
  FROM (SELECT o.*, f.n, f.l, f.objects, o.held + f.n >= 5 AS over_e, o.legendary AND o.legends + f.l > 0 AS over_l, CASE WHEN list_contains(f.objects, o.object) THEN 'already_entered' WHEN o.held + f.n >= 5 THEN 'too_many' WHEN o.legendary THEN coalesce(o.unsound, CASE WHEN o.legends + f.l > 0 THEN 'second_legendary' END) END AS why
   FROM f JOIN o ON f.season_id = o.season_id AND f.artist_uid = o.artist_uid AND o.rn = f.rn + 1))"""


def _standing(t):
    o = t["orders"].where("o_orderkey % 41 = 0")
    return o.select(F.year("o_orderdate").alias("season_id"), (F.col("o_orderkey") % 4000).cast("string").alias("object_row_id"), F.col("o_custkey").cast("string").alias("artist_uid"), (F.col("o_orderkey") % 2 == 0).alias("legendary"), F.when(F.col("o_orderkey") % 3 == 0, "rejected").otherwise("approved").alias("status"))


@query(f"WITH RECURSIVE {_REQ}, {_OLD}, c AS (SELECT r.*, r.object_row_id AS object, CASE WHEN edition_size <> 1 THEN 'edition' WHEN NOT fingerprinted THEN 'no_fingerprint' WHEN length(legend) < 40 THEN 'no_legend' END AS unsound, CASE WHEN s.season_id IS NULL THEN 'no_season' WHEN s.status <> 'open' THEN 'not_open' WHEN o.object_row_id IS NULL THEN 'not_public' WHEN o.owner_uid <> r.artist_uid THEN 'not_owner' WHEN EXISTS (SELECT 1 FROM old WHERE old.season_id = r.season_id AND old.object_row_id = r.object_row_id) THEN 'already_entered' END AS reason FROM req r LEFT JOIN sea s USING (season_id) LEFT JOIN obj o USING (object_row_id)), asked AS (SELECT * FROM c WHERE reason IS NULL), {_FOLD} SELECT id, reason FROM c WHERE reason IS NOT NULL UNION ALL SELECT id, reason FROM f WHERE rn > 0")
def enter_pieces(spark, sf_dir):
    t, req, seasons, objects = _requests(spark, sf_dir)
    return W.enter(req, seasons, objects, _standing(t))


@query(f"WITH RECURSIVE {_REQ}, {_OLD}, asked AS (SELECT *, CAST(id AS VARCHAR) AS object, CAST(NULL AS VARCHAR) AS unsound FROM req), {_FOLD} SELECT id, oe AS over_entries, ol AS over_legendary FROM f WHERE rn > 0")
def entry_limits(spark, sf_dir):
    t, req, _, _ = _requests(spark, sf_dir)
    return W.within_limits(req, _standing(t).where("status <> 'rejected'")).select("id", "over_entries", "over_legendary")


@query("WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS o, CAST(l_suppkey AS VARCHAR) AS u, least(100, greatest(0, l_quantity * 2.5 - 10)) AS s FROM lineitem), f AS (SELECT o, u, arg_min(s, id) AS first, arg_min(s, id) FILTER (WHERE s >= 70) AS good FROM r GROUP BY 1, 2), c AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS o, CAST(l_suppkey AS VARCHAR) AS u, CASE WHEN l_partkey % 3 = 0 THEN 'verified' ELSE 'pending' END AS old FROM lineitem WHERE l_partkey % 2 = 0) SELECT coalesce(f.o, c.o) AS object_row_id, coalesce(f.u, c.u) AS collector_uid, CASE WHEN good IS NOT NULL AND coalesce(old, '') <> 'verified' THEN 'verified' ELSE coalesce(old, 'pending') END AS status, CASE WHEN good IS NOT NULL AND coalesce(old, '') <> 'verified' THEN good WHEN old IS NOT NULL THEN 50.0 ELSE first END AS confidence, CASE WHEN old IS NULL THEN 'new' WHEN good IS NOT NULL AND old <> 'verified' THEN 'upgraded' ELSE 'kept' END AS outcome FROM f FULL JOIN c ON f.o = c.o AND f.u = c.u")
def record_claims(spark, sf_dir):
    item = Tables(spark, sf_dir)["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").cast("string").alias("object_row_id"), F.col("l_suppkey").cast("string").alias("collector_uid"), (F.col("l_quantity") * 2.5 - 10).alias("confidence"), "l_partkey")
    claims = item.where("l_partkey % 2 = 0").select("object_row_id", "collector_uid", F.when(F.col("l_partkey") % 3 == 0, "verified").otherwise("pending").alias("status"), F.lit(50.0).alias("confidence")).distinct()
    return W.record_claims(item.drop("l_partkey"), claims, item.select("object_row_id"))


@query("WITH e AS (SELECT object_row_id, max((season_id, id)) AS e FROM entries GROUP BY 1) SELECT c.id, CASE WHEN c.id % 2 = 0 THEN c.season_id ELSE e.e[1] END AS season_id, CASE WHEN c.id % 2 = 0 THEN c.entry_id ELSE e.e[2] END AS entry_id FROM claims c LEFT JOIN e USING (object_row_id)")
def backfill_claims(spark, sf_dir):
    t = Tables(spark, sf_dir)
    early = t.claims.withColumns({c: F.when(F.col("id") % 2 == 0, F.col(c)) for c in ("season_id", "entry_id")})
    return W.backfill_claims(early, t.entries).select("id", "season_id", "entry_id")


@query("WITH v AS (SELECT entry_id, count(*) AS n FROM votes GROUP BY 1), b AS (SELECT e.id, e.season_id, coalesce(n, 0) AS vote_count, CAST(row_number() OVER (PARTITION BY e.season_id ORDER BY coalesce(n, 0) DESC, created_at, e.id) AS INT) AS rank FROM entries e LEFT JOIN v ON entry_id = e.id) SELECT id, rank, vote_count, rank = 1 AND vote_count > 0 AS favourite FROM b WHERE season_id = 1996")
def close_season(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.close_season(G.peoples_choice(G.counted(t.entries, t.votes, t.claims)), 1996)


@query("SELECT DISTINCT artist_uid AS uid, 'maker-debut' AS badge, 0 AS season_id FROM entries WHERE CAST(artist_uid AS INT) % 3 <> 0")
def new_badges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    earned = G.badges(t.claims, t.entries).where("badge = 'maker-debut'")
    return W.award_badges(earned, earned.where("cast(uid AS int) % 3 = 0"))


@query("SELECT lower(c_mktsegment) AS winner, count(*) AS prizes, count(*) FILTER (WHERE c_nationkey = 1) AS first_places FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def prizes_won(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"]
    return W.prizes_won(c.select(F.when(F.col("c_custkey") % 2 == 0, "studio").otherwise("maker").alias("kind"), F.concat(F.lit(" "), "c_mktsegment").alias("winner"), F.col("c_nationkey").alias("rank")), "studio")


@query("WITH s AS (SELECT p_partkey AS submission_id, substr(sha256(p_name), 1, 16) AS object_row_id FROM part WHERE p_partkey % 3 <> 0), o AS (SELECT object_row_id, min(submission_id) AS submission_id FROM s GROUP BY 1) SELECT object_row_id, submission_id FROM o")
def promote_objects(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"]
    submissions = p.select(F.col("p_partkey").alias("submission_id"), F.sha2("p_name", 256).alias("content_hash"))
    decisions = submissions.select("submission_id", F.when(F.col("submission_id") % 3 != 0, "approved").otherwise("rejected").alias("status"))
    return W.promote(submissions, submissions.select("submission_id"), decisions)[0].select("object_row_id", "submission_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'host_approved' ELSE 'rejected' END WHEN o_orderstatus = 'F' THEN 'pending_host' ELSE 'host_approved' END AS status, o_orderkey % 3 = 0 AND o_orderstatus = 'F' AS moved FROM orders")
def host_review(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "pending_host").otherwise("host_approved").alias("status"))
    return W.review(rows, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("approve")), "host")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE 'objects' END AS queue, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'no_queue' WHEN o_orderstatus <> 'P' THEN 'not_waiting' WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS outcome FROM orders")
def decide_queues(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    decisions = o.select(F.when(F.col("o_orderkey") % 5 == 0, "gone").otherwise("objects").alias("queue"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("approve"))
    return W.decide(decisions, {"objects": o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), "claims": o.limit(0).select(F.col("o_orderkey").alias("id"))})


@query("WITH q AS (SELECT 'orders' AS queue, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'claims', count(*) FROM claims WHERE status = 'pending') SELECT * FROM q UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM q")
def queue_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.queue_counts({"orders": t["orders"].where("o_orderstatus = 'P'"), "claims": t.claims.where("status = 'pending'")})


@query("SELECT collector_uid AS uid, c.object_row_id, e.title, e.season_id FROM claims c LEFT JOIN entries e ON e.id = c.entry_id WHERE c.status = 'verified'")
def collections(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.collections(t.claims, t.entries)


@query("SELECT artist_uid AS owner_uid, CAST(row_number() OVER (PARTITION BY artist_uid ORDER BY CASE c.status WHEN 'pending' THEN 0 ELSE 1 END, c.created_at DESC, c.id DESC) AS INT) AS place, c.id, c.status FROM claims c JOIN entries e USING (object_row_id)")
def inbox(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.inbox(t.claims, t.entries.select("object_row_id", F.col("artist_uid").alias("owner_uid")))


@query("SELECT 'user' || user_id || '@x' AS email, count(*) AS n, min(ts) AS first, max(ts) AS last, bool_or(event_type = 'error') OR user_id % 7 = 0 AS is_admin FROM events GROUP BY user_id")
def logins(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    events = e.select(F.concat(F.lit(" USER"), "user_id", F.lit("@x")).alias("email"), "ts", (F.col("event_type") == "error").alias("admin"))
    return W.logins(events, e.where("user_id % 7 = 0").select(F.concat(F.lit("user"), "user_id", F.lit("@X ")).alias("email")))


@query("WITH n AS (SELECT season_id, count(*) AS entries, count(DISTINCT artist_uid) AS makers FROM entries GROUP BY 1) SELECT s.season_id, s.status, entries, makers, s.season_id = (SELECT arg_max(season_id, starts) FROM seasons WHERE status = 'open') AS is_current FROM seasons s JOIN n USING (season_id)")
def seasons_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.seasons_list(t.seasons, t.entries).select("season_id", "status", "entries", "makers", "is_current")


@query("SELECT s_suppkey AS id, s_suppkey % 3 <> 0 AND (s_suppkey % 4 <> 0 OR s_acctbal > 0) AS open, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS n_pending_host, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n_approved FROM supplier LEFT JOIN orders ON o_custkey = s_suppkey WHERE s_suppkey % 2 = 0 GROUP BY s_suppkey, s_acctbal")
def event_directory(spark, sf_dir):
    t = Tables(spark, sf_dir)
    day = lambda d: F.lit(d).cast("date")
    events = t["supplier"].select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "closed").otherwise("open").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, F.when(F.col("s_acctbal") > 0, day("2024-01-01")).otherwise(day("2024-03-01"))).alias("opens"), F.lit(None).cast("date").alias("closes"), (F.col("s_suppkey") % 2 == 0).alias("listed"))
    regs = t["orders"].select(F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderstatus") == "P", "pending_host").when(F.col("o_orderstatus") == "F", "approved").otherwise("other").alias("status"))
    return W.event_directory(events, regs, "2024-02-01").select("id", "open", "n_pending_host", "n_approved")


@query("SELECT user_id AS session, arg_max(event_type, event_id) AS decision, string_agg(event_type, ',' ORDER BY event_id) AS history FROM events GROUP BY 1")
def session_decisions(spark, sf_dir):
    log = Tables(spark, sf_dir)["events"].select(F.col("user_id").alias("session"), F.col("event_type").alias("decision"), F.col("event_id").alias("ts"))
    return W.session_decisions(log).withColumn("history", F.array_join("history", ","))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_with_dependants(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.delete_where(t["orders"], F.col("o_orderstatus") == "F", "o_orderkey", {"items": (t["lineitem"], "l_orderkey")})["items"].agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'rejected' ELSE 'approved' END AS status, count(*) AS n FROM orders GROUP BY 1")
def approve_existing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.approve_existing({"orders": t.rows_}, t.approvals).groupBy("status").agg(F.count("*").alias("n"))


_CARDS = "cards AS (SELECT CAST(o_orderkey AS VARCHAR) AS object_row_id, o_custkey AS user_id, coalesce(n, 0) AS images, coalesce(n, 0) AS events, CASE o_orderstatus WHEN 'F' THEN 'published' ELSE 'private' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def _cards(spark, sf_dir):
    t = Tables(spark, sf_dir)
    objects = t["orders"].select(F.col("o_orderkey").cast("string").alias("object_row_id"), F.col("o_custkey").alias("user_id"))
    details = t["lineitem"].select(F.col("l_orderkey").cast("string").alias("object_row_id"))
    return t, W.object_cards(objects, details, details, t.approvals)


@query(f"WITH {_CARDS} SELECT * FROM cards")
def object_cards(spark, sf_dir):
    return _cards(spark, sf_dir)[1]


@query(f"WITH {_CARDS}, w AS (SELECT object_row_id, count(*) AS w FROM claims WHERE status = 'pending' GROUP BY 1) SELECT user_id, count(*) AS pieces, count(*) FILTER (WHERE state = 'published') AS published, count(*) FILTER (WHERE state = 'in_review') AS in_review, CAST(coalesce(sum(w), 0) AS BIGINT) AS claims_waiting FROM cards LEFT JOIN w USING (object_row_id) GROUP BY 1")
def owner_dashboard(spark, sf_dir):
    t, cards = _cards(spark, sf_dir)
    return W.owner_dashboard(cards, t.claims)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS object_row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'register' WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderstatus = 'P' THEN 'review' ELSE 'publish' END WHEN o_orderkey % 3 = 0 THEN 'confirm' WHEN o_orderkey % 5 = 0 THEN 'enter' ELSE 'done' END AS step FROM orders")
def next_steps(spark, sf_dir):
    o, k = Tables(spark, sf_dir)["orders"], F.col("o_orderkey")
    return o.select(k.cast("string").alias("object_row_id"), W.next_step(k % 2 != 0, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", k % 3 != 0, k % 5 != 0).alias("step"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS object_row_id, sha256('{\"title\":\"' || p_name || '\",\"maker\":\"' || p_brand || '\",\"provenance\":[{\"at\":\"1\",\"kind\":\"made\"},{\"at\":\"2\",\"kind\":\"sold\"}]}') AS content_hash FROM part")
def manifests(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"].select(F.col("p_partkey").cast("string").alias("object_row_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("maker"))
    events = p.select("object_row_id", F.explode(F.array(F.struct(F.lit("2").alias("at"), F.lit("sold").alias("kind")), F.struct(F.lit("1").alias("at"), F.lit("made").alias("kind")))).alias("e")).select("object_row_id", "e.*")
    return W.manifests(p, events).select("object_row_id", "content_hash")


@query("SELECT _row_id FROM rows_ JOIN (SELECT o_orderkey AS k, o_orderdate AS created_at FROM orders) ON k = o_orderkey WHERE _row_id IN (SELECT row_id FROM approvals WHERE status = 'approved') ORDER BY created_at DESC, _row_id DESC LIMIT 24")
def recents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dated = t.rows_.join(t["orders"].select("o_orderkey", F.col("o_orderdate").alias("created_at")), "o_orderkey")
    return W.recents(dated, "orders", t.approvals).select("_row_id")


@query("WITH m AS (SELECT artist_uid AS maker, count(*) AS entries, count(*) FILTER (WHERE fingerprinted) AS registered FROM entries GROUP BY 1), b AS (SELECT 'entries' AS board, maker, CAST(entries AS DOUBLE) AS value FROM m UNION ALL SELECT 'registered', maker, registered FROM m WHERE registered > 0) SELECT board, CAST(row_number() OVER (PARTITION BY board ORDER BY value DESC, maker) AS INT) AS rank, maker, value FROM b QUALIFY rank <= 10")
def maker_leaderboards(spark, sf_dir):
    m = Tables(spark, sf_dir).entries.groupBy(F.col("artist_uid").alias("maker")).agg(F.count("*").alias("entries"), F.count_if("fingerprinted").alias("registered"))
    return W.maker_leaderboards(m, {"entries": "entries", "registered": "registered"})


@query("SELECT id, season_id, title, CAST(artist_uid = '7' AS BOOLEAN) AS mine, CASE WHEN artist_uid = '7' OR id % 2 = 0 THEN legendary END AS legendary FROM entries")
def redact_entries(spark, sf_dir):
    from tessera.operators.tables import redact_entries as redact

    e = Tables(spark, sf_dir).entries.withColumn("rarity", F.when(F.col("id") % 2 == 0, "legendary").otherwise("rare"))
    return redact(e, "7").select("id", "season_id", "title", "mine", "legendary")


@query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(1) || chr(2)) = sha256(CAST(o_orderkey AS VARCHAR) || chr(1) || chr(2)) AND o_orderkey % 2 = 0 AS valid FROM orders")
def commitments_checked(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"].select("o_orderkey", F.col("o_orderkey").cast("string").alias("v"))
    made = T.commitment(F.when(F.col("o_orderkey") % 2 == 0, F.col("v")).otherwise(F.concat("v", F.lit("!"))), F.lit("0102"))
    return o.select("o_orderkey", (made == T.commitment(F.col("v"), F.lit("0102"))).alias("valid"))
