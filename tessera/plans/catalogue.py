"""Every registered query with its oracle, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import games as G
from tessera.operators import graph as N
from tessera.operators import profile as P
from tessera.operators import registry as R
from tessera.operators import resolution as E
from tessera.operators import usage as U
from tessera.plans.base import ORACLES, QUERIES, Tables, query
from tessera.streaming import usage as S

# --- gate, search, pages ---------------------------------------------------------------------


@query("SELECT _row_id, o_totalprice FROM rows_ WHERE _row_id IN (SELECT row_id FROM approvals WHERE status = 'approved')")
def gate_approved(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.gate(t.rows_, "orders", t.approvals).select("_row_id", "o_totalprice")


@query("SELECT _row_id, o_totalprice FROM rows_ WHERE _row_id NOT IN (SELECT row_id FROM approvals WHERE status = 'rejected')")
def gate_not_rejected(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.gate_include_pending(t.rows_, "orders", t.approvals).select("_row_id", "o_totalprice")


@query("SELECT _row_id, o_totalprice FROM rows_ WHERE _row_id NOT IN (SELECT row_id FROM approvals)")
def gate_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.pending(t.rows_, "orders", t.approvals).select("_row_id", "o_totalprice")


@query("SELECT (SELECT count(*) FROM orders) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, greatest(0, (SELECT count(*) FROM orders) - count(*)) AS pending FROM approvals")
def gate_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.gate_counts(t["orders"], "orders", t.approvals)


@query("WITH hit AS (SELECT * FROM rows_ WHERE _row_id IN (SELECT row_id FROM approvals WHERE status = 'approved') AND o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urg')) SELECT _row_id, o_totalprice, o_orderpriority, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY o_totalprice DESC, _row_id LIMIT 50 OFFSET 10")
def gated_search_page(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hits = R.search(R.filter_equals(R.gate(t.rows_, "orders", t.approvals), {"o_orderstatus": "F", "nowhere": 1}), "URG", ["o_orderpriority"])
    return R.page(hits, "o_totalprice", True, 50, 10).select("_row_id", "o_totalprice", "o_orderpriority", "total")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(CAST(c_custkey AS VARCHAR), 'build 7') OR (contains(lower(c_name || ' ' || c_mktsegment), 'build') AND contains(lower(c_name || ' ' || c_mktsegment), '7'))")
def token_search(spark, sf_dir):
    return R.search_tokens(Tables(spark, sf_dir)["customer"], "build 7", "c_custkey", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("WITH u AS (SELECT 's' || s_suppkey AS gid, s_name AS label, 0 AS source_rank FROM supplier WHERE contains(lower(s_name), '00001') UNION ALL SELECT 'c' || c_custkey, c_name, 1 FROM customer WHERE contains(lower(c_name), '00001')) SELECT * FROM u ORDER BY source_rank, CASE WHEN lower(label) = '00001' THEN 0 ELSE 1 END, length(label), label, gid LIMIT 25")
def record_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("gid"), "s_name")
    c = t["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("gid"), "c_name")
    return R.search_records([(s, "gid", "s_name"), (c, "gid", "c_name")], "00001", 25)


@query("WITH n AS (SELECT 0 AS ordinal, 'region' AS tbl FROM region WHERE contains(lower(r_name), 'nation_1') UNION ALL SELECT 1, 'nation' FROM nation WHERE contains(lower(n_name), 'a') UNION ALL SELECT 2, 'customer' FROM customer WHERE contains(lower(c_name), 'a')) SELECT tbl, ordinal FROM n ORDER BY ordinal LIMIT 1")
def first_table_with(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.first_table_with("a", [("region", t["region"].where("contains(lower(r_name), 'nation_1')"), "r_name"), ("nation", t["nation"], "n_name"), ("customer", t["customer"], "c_name")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 70 = 0")
def upsert_last_wins(spark, sf_dir):
    base = Tables(spark, sf_dir)["orders"].select("o_orderkey", "o_totalprice", F.lit(0).alias("seq"))
    changed = base.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("seq"))
    older = base.where("o_orderkey % 14 = 0").select("o_orderkey", (F.col("o_totalprice") * 3).alias("o_totalprice"), F.lit(1).alias("seq"))
    added = base.where("o_orderkey % 70 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("seq"))
    return R.upsert(base, changed.unionByName(older).unionByName(added), "o_orderkey", "seq").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'update' END AS change, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderkey % 3 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS columns FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 UNION ALL SELECT -1 - o_orderkey, 'insert', NULL FROM orders WHERE o_orderkey % 13 = 0")
def edit_diff(spark, sf_dir):
    old = Tables(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    new = new.unionByName(old.where("o_orderkey % 13 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    out = R.apply_edits(old, new, "o_orderkey")
    return out.withColumn("columns", F.array_join("columns", ","))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal < 0 AS touched FROM customer")
def bulk_set(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"]
    return R.bulk_set(c, "c_mktsegment", "CLOSED", F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment", F.col("_set").alias("touched"))


@query("SELECT p_partkey, replace(p_type, 'STEEL', 'IRON') AS p_type FROM part")
def find_replace(spark, sf_dir):
    return R.find_replace(Tables(spark, sf_dir)["part"], "p_type", "STEEL", "IRON").select("p_partkey", "p_type")


@query("WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n")
def unique_slugs(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"].select("p_partkey", T.slug(F.col("p_brand")).alias("base"))
    return R.number_repeats(p, "base", ["p_partkey"], "slug").select("p_partkey", "slug")


@query("SELECT c_custkey, substr(sha1('customer|' || c_name || '|' || c_mktsegment), 1, 16) AS row_id FROM customer")
def stable_row_id(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"]
    return c.select("c_custkey", T.row_id("customer", [F.col("c_name"), F.col("c_mktsegment")], {x: F.col(x) for x in c.columns}).alias("row_id"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    return R.status_counts(Tables(spark, sf_dir)["orders"], "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_mktsegment AS domain, count(DISTINCT c_nationkey) AS datasets, count(*) AS n_rows FROM customer GROUP BY 1")
def domain_rollup(spark, sf_dir):
    return Tables(spark, sf_dir)["customer"].groupBy(F.col("c_mktsegment").alias("domain")).agg(F.countDistinct("c_nationkey").alias("datasets"), F.count("*").alias("n_rows"))


@query("WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS row_id FROM orders WHERE o_orderstatus = 'P') SELECT status, count(*) AS n FROM (SELECT row_id, status FROM approvals UNION ALL SELECT row_id, 'approved' FROM p) GROUP BY 1")
def approve_all_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = R.pending(t.rows_, "orders", t.approvals).select(F.col("_row_id").alias("row_id"))
    return R.set_status(t.approvals, "orders", ids, "approved").groupBy("status").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT * FROM orders), c AS (SELECT c_custkey AS id, c_name AS label FROM customer), s AS (SELECT s_suppkey AS id, s_name AS label FROM supplier) SELECT id, label FROM s UNION ALL SELECT id, label FROM c WHERE id NOT IN (SELECT id FROM s)")
def prioritised_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    c = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return R.priority_union([s, c], "id")


# --- profiles --------------------------------------------------------------------------------

_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "WITH p AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS n_filled, count(try_cast(nullif(trim(CAST({c} AS VARCHAR)), '') AS DOUBLE)) AS n_numeric, count(DISTINCT nullif(trim(CAST({c} AS VARCHAR)), '')) AS n_values, count(DISTINCT try_cast(nullif(trim(CAST({c} AS VARCHAR)), '') AS DOUBLE)) AS n_numbers, count(*) AS n FROM customer" for c in _COLUMNS)
    + ") SELECT \"column\", n_filled, n_numeric, n_values, n_numbers, CASE WHEN n_filled = 0 THEN 'empty' WHEN n_numeric > 0.6 * n_filled AND n_numbers > 3 THEN 'numeric' WHEN n_values BETWEEN 2 AND 120 AND n_values < 0.9 * n THEN 'categorical' ELSE 'other' END AS kind FROM p"
)
def column_profile(spark, sf_dir):
    return P.profile_columns(Tables(spark, sf_dir)["customer"])


@query("SELECT trim(p_type) AS value, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
def value_counts(spark, sf_dir):
    return P.value_counts(Tables(spark, sf_dir)["part"], "p_type")


@query("WITH e AS (SELECT quantile_cont(o_totalprice, 0.02) AS lo, quantile_cont(o_totalprice, 0.98) AS hi FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi FROM orders, e WHERE o_totalprice BETWEEN lo AND hi) SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi")
def trimmed_histogram(spark, sf_dir):
    return P.histogram(Tables(spark, sf_dir)["orders"], "o_totalprice", 2024)


@query("SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1850 AND 2024 GROUP BY 1")
def decade_histogram(spark, sf_dir):
    return P.decade_histogram(Tables(spark, sf_dir)["orders"].select(F.year("o_orderdate").cast("string").alias("y")), "y", 2024)


@query("SELECT 'c_mktsegment' AS facet, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2")
def group_options(spark, sf_dir):
    return P.group_options(Tables(spark, sf_dir)["customer"], ["c_mktsegment", "c_nationkey"])


# --- usage -----------------------------------------------------------------------------------


@query("SELECT count(*) AS views, count(DISTINCT session) AS visitors FROM usage WHERE event = 'view' AND day >= (SELECT max(day) FROM usage) - 30")
def usage_totals(spark, sf_dir):
    return U.usage_totals(U.since(Tables(spark, sf_dir).usage, 30))


@query("SELECT surface, count(*) AS views, count(DISTINCT session) AS visitors FROM usage WHERE event = 'view' AND day >= (SELECT max(day) FROM usage) - 30 GROUP BY 1")
def usage_by_surface(spark, sf_dir):
    return U.usage_by(U.since(Tables(spark, sf_dir).usage, 30), "surface")


@query("SELECT surface || ' · ' || view AS label, count(*) AS views FROM usage WHERE event = 'view' AND view <> '' GROUP BY 1 ORDER BY views DESC, label LIMIT 15")
def usage_by_view_top(spark, sf_dir):
    return U.usage_by_view(Tables(spark, sf_dir).usage)


@query("SELECT country, count(DISTINCT session) AS visitors FROM usage WHERE country <> '' GROUP BY 1 ORDER BY visitors DESC, country LIMIT 15")
def usage_by_country(spark, sf_dir):
    return U.usage_by_country(Tables(spark, sf_dir).usage)


@query("SELECT event, count(*) AS n FROM usage WHERE event <> 'view' GROUP BY 1 ORDER BY n DESC, event LIMIT 15")
def usage_by_event(spark, sf_dir):
    return U.usage_by_event(Tables(spark, sf_dir).usage)


@query("SELECT day, count(*) AS views, count(DISTINCT session) AS visitors FROM usage WHERE event = 'view' GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return U.usage_by(Tables(spark, sf_dir).usage, "day")


@query("WITH c AS (SELECT DISTINCT view AS code FROM usage UNION SELECT 'never'), m AS (SELECT max(day) - 7 AS d FROM usage), u AS (SELECT view AS code, count(*) FILTER (WHERE day >= d) AS scans, count(DISTINCT nullif(session, '')) FILTER (WHERE day >= d) AS people, min(ts) FILTER (WHERE day >= d) AS first, max(ts) FILTER (WHERE day >= d) AS last, count(*) AS all_time FROM usage, m WHERE surface = 'qr' AND event = 'qr:scan' GROUP BY 1) SELECT code, coalesce(scans, 0) AS scans, coalesce(people, 0) AS people, first, last, coalesce(all_time, 0) AS all_time FROM c LEFT JOIN u USING (code)")
def code_stats(spark, sf_dir):
    u = Tables(spark, sf_dir).usage
    codes = u.select(F.col("view").alias("code")).distinct().unionAll(spark.range(1).select(F.lit("never").alias("code")))
    return U.code_stats(u, codes, 7)


@query("SELECT view AS code, day, count(*) AS scans, count(DISTINCT nullif(session, '')) AS people FROM usage WHERE surface = 'qr' AND event = 'qr:scan' AND day >= (SELECT max(day) FROM usage) - 7 GROUP BY 1, 2")
def code_stats_by_day(spark, sf_dir):
    u = Tables(spark, sf_dir).usage
    return U.code_stats_by_day(u, u.select(F.col("view").alias("code")).distinct(), 7)


@query("SELECT (SELECT count(*) FROM customer) AS makers, (SELECT count(*) FROM supplier) AS studios, (SELECT count(*) FROM orders) AS objects, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS objects_public, (SELECT count(DISTINCT n_regionkey) FROM nation) AS regions")
def site_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = t["customer"].agg(F.count("*").alias("makers")).crossJoin(t["supplier"].agg(F.count("*").alias("studios")))
    one = one.crossJoin(t["orders"].agg(F.count("*").alias("objects"), F.count_if(F.col("o_orderstatus") == "F").alias("objects_public")))
    return one.crossJoin(t["nation"].agg(F.countDistinct("n_regionkey").alias("regions")))


# --- competitions ----------------------------------------------------------------------------

_COUNTED = "counted AS (SELECT e.*, coalesce(v.n, 0) AS vote_count, coalesce(c.n, 0) AS claim_count, CASE WHEN legendary AND coalesce(c.n, 0) > 0 THEN 'legendary' WHEN fingerprinted AND edition_size <= 3 THEN 'rare' WHEN fingerprinted THEN 'uncommon' ELSE 'common' END AS rarity FROM entries e LEFT JOIN (SELECT entry_id, count(*) AS n FROM votes GROUP BY 1) v ON v.entry_id = e.id LEFT JOIN (SELECT object_row_id, count(*) AS n FROM claims WHERE status = 'verified' GROUP BY 1) c ON c.object_row_id = e.object_row_id)"


def _counted(t: Tables) -> DataFrame:
    return G.counted(t.entries, t.votes, t.claims)


@query(f"WITH {_COUNTED} SELECT season_id, id, vote_count, CAST(row_number() OVER (PARTITION BY season_id ORDER BY vote_count DESC, created_at, id) AS INT) AS rank FROM counted")
def peoples_choice(spark, sf_dir):
    return G.peoples_choice(_counted(Tables(spark, sf_dir))).select("season_id", "id", "vote_count", "rank")


@query(f"WITH {_COUNTED} SELECT season_id, id, claim_count, CAST(row_number() OVER (PARTITION BY season_id ORDER BY claim_count DESC, vote_count DESC, created_at, id) AS INT) AS rank FROM counted")
def most_collected(spark, sf_dir):
    return G.most_collected(_counted(Tables(spark, sf_dir))).select("season_id", "id", "claim_count", "rank")


@query(f"WITH {_COUNTED}, b AS (SELECT season_id, studio, count(DISTINCT artist_uid) AS makers, count(*) AS entries, CAST(sum(claim_count) AS BIGINT) AS claims, CAST(sum(vote_count) AS BIGINT) AS votes, count(*) FILTER (WHERE fingerprinted) AS registered FROM counted GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY makers DESC, entries DESC, claims DESC, votes DESC, lower(studio)) AS INT) AS rank FROM b")
def studio_board(spark, sf_dir):
    return G.studio_board(_counted(Tables(spark, sf_dir))).select("season_id", "studio", "makers", "entries", "claims", "votes", "registered", "rank")


@query(f"WITH {_COUNTED}, b AS (SELECT season_id, artist_uid AS maker, min(artist_name) AS artist_name, count(*) AS entries, count(*) FILTER (WHERE fingerprinted) AS registered, CAST(sum(claim_count) AS BIGINT) AS claims, CAST(sum(vote_count) AS BIGINT) AS votes FROM counted GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY registered DESC, entries DESC, claims DESC, votes DESC, lower(artist_name), maker) AS INT) AS rank FROM b")
def maker_board(spark, sf_dir):
    return G.maker_board(_counted(Tables(spark, sf_dir))).select("season_id", "maker", "artist_name", "entries", "registered", "claims", "votes", "rank")


@query(f"WITH {_COUNTED}, b AS (SELECT c.season_id, collector_uid, max(collector_name) AS collector_name, CAST(sum(CASE rarity WHEN 'legendary' THEN 20 WHEN 'rare' THEN 5 WHEN 'uncommon' THEN 2 ELSE 1 END) AS BIGINT) AS points, count(*) AS pieces, count(*) FILTER (WHERE rarity = 'legendary') AS legendaries, count(DISTINCT studio) AS studios FROM claims c JOIN counted e ON c.entry_id = e.id AND c.season_id = e.season_id WHERE c.status = 'verified' GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY season_id ORDER BY points DESC, pieces DESC, collector_name, collector_uid) AS INT) AS rank FROM b")
def points_board(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.points_board(_counted(t), t.claims).select("season_id", "collector_uid", "collector_name", "points", "pieces", "legendaries", "studios", "rank")


_BADGES = """c AS (SELECT collector_uid AS uid, c.season_id, studio, legendary FROM claims c LEFT JOIN entries e ON c.entry_id = e.id WHERE c.status = 'verified'),
 shops AS (SELECT season_id, count(DISTINCT studio) AS n FROM entries GROUP BY 1),
 badges_ AS (SELECT DISTINCT uid, 'first-scan' AS badge, 0 AS season_id FROM c UNION ALL SELECT DISTINCT uid, 'legend_hunter', 0 FROM c WHERE legendary
  UNION ALL SELECT uid, 'five-shops', 0 FROM c GROUP BY uid HAVING count(DISTINCT studio) >= 5 UNION ALL SELECT uid, 'three-seasons', 0 FROM c GROUP BY uid HAVING count(DISTINCT season_id) >= 3
  UNION ALL SELECT DISTINCT artist_uid, 'maker-debut', 0 FROM entries
  UNION ALL SELECT uid, 'set-complete', c.season_id FROM c JOIN shops s ON c.season_id = s.season_id GROUP BY uid, c.season_id, n HAVING count(DISTINCT studio) = n AND n >= 2)"""


@query(f"WITH {_BADGES} SELECT uid, badge, season_id FROM badges_")
def badges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.badges(t.claims, t.entries)


@query(f"WITH {_BADGES}, b AS (SELECT uid, count(*) AS n FROM badges_ GROUP BY 1), o AS (SELECT collector_uid, max(collector_name) AS collector_name, count(DISTINCT c.object_row_id) AS pieces, count(DISTINCT studio) AS studios, count(DISTINCT c.season_id) AS seasons, min(c.created_at) AS since FROM claims c LEFT JOIN entries e ON c.entry_id = e.id WHERE c.status = 'verified' GROUP BY 1) SELECT o.*, coalesce(n, 0) AS badges, CAST(row_number() OVER (ORDER BY pieces DESC, studios DESC, coalesce(n, 0) DESC, since, collector_uid) AS INT) AS rank FROM o LEFT JOIN b ON uid = collector_uid")
def collectors_board(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.collectors_board(t.claims, t.entries, G.badges(t.claims, t.entries))


@query("WITH p AS (SELECT season_id, category_id, entry_id AS id, CAST(count(*) AS DOUBLE) AS value FROM award_votes GROUP BY 1, 2, 3), b AS (SELECT c.season_id, c.category_id, c.kind, e.id, p.value, e.created_at FROM categories c JOIN p ON p.season_id = c.season_id AND p.category_id = c.category_id JOIN entries e ON e.id = p.id AND e.season_id = c.season_id WHERE c.kind = 'vote' AND (NOT c.solo_only OR e.solo) UNION ALL SELECT c.season_id, c.category_id, c.kind, e.id, e.height_mm, e.created_at FROM categories c JOIN entries e ON e.season_id = c.season_id WHERE c.kind = 'measured' AND e.height_mm IS NOT NULL AND (NOT c.solo_only OR e.solo)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY season_id, category_id ORDER BY value DESC, created_at, id) AS INT) AS rank FROM b) SELECT season_id, category_id, id, value, rank FROM r WHERE kind = 'measured' OR rank <= 5")
def award_standings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.award_standings(t.entries, t.categories, t.award_votes)


@query("SELECT season_id, id, height_mm AS value, CAST(row_number() OVER (PARTITION BY season_id ORDER BY height_mm DESC, created_at, id) AS INT) AS rank FROM entries WHERE height_mm IS NOT NULL")
def measured_award(spark, sf_dir):
    return G.measured_award(Tables(spark, sf_dir).entries)


@query("SELECT min(season_id) AS season_id, artist_uid FROM entries GROUP BY artist_uid HAVING count(DISTINCT season_id) = 1")
def rookies(spark, sf_dir):
    return G.first_timers(Tables(spark, sf_dir).entries)


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY season_id, voter_uid ORDER BY created_at, id) AS k FROM votes) SELECT id, season_id, entry_id, voter_uid FROM n WHERE k <= 20")
def vote_cap(spark, sf_dir):
    return G.within_cap(Tables(spark, sf_dir).votes, 20).select("id", "season_id", "entry_id", "voter_uid")


@query("WITH l AS (SELECT *, CASE WHEN entry_id IS NOT DISTINCT FROM lag(entry_id) OVER w THEN 0 ELSE 1 END AS new FROM award_votes WINDOW w AS (PARTITION BY season_id, category_id, voter_uid ORDER BY created_at, id)), r AS (SELECT *, sum(new) OVER (PARTITION BY season_id, category_id, voter_uid ORDER BY created_at, id) AS run FROM l), e AS (SELECT season_id, category_id, voter_uid, run, count(*) AS n, max(entry_id) AS entry_id, row_number() OVER (PARTITION BY season_id, category_id, voter_uid ORDER BY run DESC) AS k FROM r GROUP BY 1, 2, 3, 4) SELECT season_id, category_id, voter_uid, entry_id FROM e WHERE k = 1 AND n % 2 = 1")
def latest_pick(spark, sf_dir):
    return G.fold_picks(Tables(spark, sf_dir).award_votes)


@query()
def vote_toggles(spark, sf_dir):
    return G.fold_votes(Tables(spark, sf_dir).votes, 50)


@query("WITH n AS (SELECT c.season_id, collector_uid, count(DISTINCT studio) AS own FROM claims c JOIN entries e ON c.entry_id = e.id WHERE c.status = 'verified' GROUP BY 1, 2), s AS (SELECT season_id, count(DISTINCT studio) AS n FROM entries GROUP BY 1) SELECT season_id, collector_uid FROM n JOIN s USING (season_id) WHERE own = s.n AND s.n >= 2")
def set_complete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    held = t.claims.where("status = 'verified'").join(t.entries.select(F.col("id").alias("entry_id"), "studio"), "entry_id")
    return G.holds_all(held, t.entries, "season_id", "studio", "collector_uid")


@query(f"WITH {_COUNTED}, r AS (SELECT artist_uid, vote_count, row_number() OVER (PARTITION BY season_id ORDER BY vote_count DESC, created_at, id) AS rank FROM counted), b AS (SELECT artist_uid, CAST(min(rank) AS INT) AS best_rank FROM r WHERE vote_count > 0 GROUP BY 1), p AS (SELECT artist_uid, count(DISTINCT season_id) AS events, count(*) AS entries, CAST(sum(vote_count) AS BIGINT) AS votes, CAST(sum(claim_count) AS BIGINT) AS collected FROM counted GROUP BY 1) SELECT p.*, best_rank FROM p LEFT JOIN b USING (artist_uid)")
def career(spark, sf_dir):
    return G.career(_counted(Tables(spark, sf_dir)))


@query("SELECT c_custkey, CAST(round_even(100.0 * (1 + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END + CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END + CASE WHEN c_mktsegment <> 'BUILDING' THEN 4 ELSE 0 END) / 8, 0) AS INT) AS percent FROM customer")
def completeness(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"]
    fields = {"name": (1, F.col("c_name").isNotNull()), "bio": (2, F.col("c_acctbal") > 0), "place": (1, F.col("c_nationkey") < 10), "studio": (4, F.col("c_mktsegment") != "BUILDING")}
    return G.completeness(c, fields).select("c_custkey", "percent")


@query(f"WITH {_COUNTED}, m AS (SELECT artist_uid, count(*) AS n, count(*) FILTER (WHERE fingerprinted) AS r, count(DISTINCT season_id) AS ev, sum(vote_count) AS v, sum(claim_count) AS c FROM counted GROUP BY 1) SELECT artist_uid, CAST(least(100, round_even(0.4 * 50, 0) + least(20, round_even(20 * ln(1 + n) / ln(31), 0)) + round_even(10.0 * r / n, 0) + least(10, 4 * ev) + least(10, round_even(v / 5 + c * 2, 0)) + 2) AS INT) AS score FROM m")
def knowledge_board(spark, sf_dir):
    m = _counted(Tables(spark, sf_dir)).groupBy("artist_uid").agg(F.count("*").alias("n"), F.count_if("fingerprinted").alias("r"), F.countDistinct("season_id").alias("ev"), F.sum("vote_count").alias("v"), F.sum("claim_count").alias("c"))
    zero = F.lit(0)
    return m.select("artist_uid", G.knowledge_score(F.lit(50), F.col("n"), F.col("r"), F.col("ev"), F.col("v"), F.col("c"), zero, zero, zero, F.lit(2)).alias("score"))


def _prize(kind: str, source: str, name: str, metric: str, order: str, where: str = "true") -> str:
    return f"SELECT season_id, '{kind}' AS awarded_for, CAST(row_number() OVER (PARTITION BY season_id ORDER BY {metric} DESC, {order}) AS INT) AS rank, {name} AS name, CAST({metric} AS BIGINT) AS value FROM {source} WHERE {metric} > 0 AND {where}"


@query(
    f"WITH {_COUNTED}, st AS (SELECT season_id, studio, count(DISTINCT artist_uid) AS makers, count(*) AS entries, sum(claim_count) AS claims, sum(vote_count) AS votes FROM counted GROUP BY 1, 2), mk AS (SELECT season_id, artist_uid AS maker, min(artist_name) AS artist_name, count(*) AS entries, count(*) FILTER (WHERE fingerprinted) AS registered, sum(claim_count) AS claims, sum(vote_count) AS votes FROM counted GROUP BY 1, 2), rk AS (SELECT artist_uid FROM entries GROUP BY 1 HAVING count(DISTINCT season_id) = 1), pt AS (SELECT c.season_id, collector_uid, max(collector_name) AS collector_name, sum(CASE rarity WHEN 'legendary' THEN 20 WHEN 'rare' THEN 5 WHEN 'uncommon' THEN 2 ELSE 1 END) AS points, count(*) AS pieces, count(DISTINCT studio) AS studios FROM claims c JOIN counted e ON c.entry_id = e.id AND c.season_id = e.season_id WHERE c.status = 'verified' GROUP BY 1, 2), b AS ("
    + " UNION ALL ".join(
        [_prize("peoples_choice", "counted", "title", "vote_count", "created_at, id"), _prize("most_collected", "counted", "title", "claim_count", "vote_count DESC, created_at, id")]
        + [_prize(f"studio_{k}", "st", "studio", m, "entries DESC, claims DESC, votes DESC, lower(studio)") for k, m in (("most_makers", "makers"), ("most_pieces", "entries"), ("most_collected", "claims"))]
        + [_prize(f"maker_{k}", "mk", "artist_name", m, "registered DESC, entries DESC, votes DESC, lower(artist_name), maker") for k, m in (("most_registered", "registered"), ("most_collected", "claims"), ("most_votes", "votes"))]
        + [_prize("rookie", "mk", "artist_name", "votes", "registered DESC, entries DESC, votes DESC, lower(artist_name), maker", "maker IN (SELECT artist_uid FROM rk)")]
        + [_prize(f"collector_{k}", "pt", "collector_name", m, "points DESC, pieces DESC, lower(collector_name), collector_uid") for k, m in (("most_points", "points"), ("most_pieces", "pieces"), ("most_studios", "studios"))]
    )
    + ") SELECT * FROM b WHERE rank <= 3"
)
def prize_standings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.prize_standings(_counted(t), t.claims, t.entries)


# --- joins -----------------------------------------------------------------------------------


@query("SELECT c.id, collector_uid, c.status, e.title, e.studio FROM claims c LEFT JOIN entries e ON c.entry_id = e.id")
def claims_chain(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.claims.join(t.entries.select(F.col("id").alias("entry_id"), "title", "studio"), "entry_id", "left").select("id", "collector_uid", "status", "title", "studio")


@query("SELECT artist_uid, count(*) AS claims, count(*) FILTER (WHERE c.status = 'pending') AS waiting FROM claims c JOIN entries e USING (object_row_id) GROUP BY 1")
def rows_on_my_pieces(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.claims.join(t.entries.select("object_row_id", "artist_uid"), "object_row_id").groupBy("artist_uid").agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "pending").alias("waiting"))


@query("SELECT artist_uid, id, title FROM entries QUALIFY row_number() OVER (PARTITION BY artist_uid ORDER BY created_at DESC, id DESC) = 1")
def latest_entry(spark, sf_dir):
    return R.latest_per_key(Tables(spark, sf_dir).entries, ["artist_uid"], [F.desc("created_at"), F.desc("id")]).select("artist_uid", "id", "title")


@query("SELECT id, season_id FROM entries WHERE legendary AND object_row_id NOT IN (SELECT object_row_id FROM claims WHERE status = 'verified')")
def unclaimed_legendaries(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.entries.where("legendary").join(t.claims.where("status = 'verified'"), "object_row_id", "left_anti").select("id", "season_id")


@query("SELECT object_row_id, count(*) FILTER (WHERE status = 'verified') AS n_verified, count(*) FILTER (WHERE status = 'pending') AS n_pending FROM claims GROUP BY 1")
def claim_counts(spark, sf_dir):
    return R.status_counts(Tables(spark, sf_dir).claims, "object_row_id", "status", ["verified", "pending"])


# --- text ------------------------------------------------------------------------------------


@query("SELECT s_suppkey, lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g'))) AS a, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS b FROM supplier")
def norm_names(spark, sf_dir):
    return Tables(spark, sf_dir)["supplier"].select("s_suppkey", T.norm(F.col("s_name")).alias("a"), T.fold(F.col("s_name")).alias("b"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type || '|' || p_brand, '|'), lambda x: trim(x)), '/') AS parts FROM part")
def split_multi(spark, sf_dir):
    return Tables(spark, sf_dir)["part"].select("p_partkey", F.array_join(T.split_multi(F.concat("p_type", F.lit("|"), "p_brand")), "/").alias("parts"))


@query("SELECT n_nationkey, n_name AS city, CAST(n_regionkey AS VARCHAR) AS region, 'X' AS country FROM nation")
def place_parts(spark, sf_dir):
    n = Tables(spark, sf_dir)["nation"]
    return n.select("n_nationkey", T.place_parts(F.concat_ws(", ", "n_name", "n_regionkey", F.lit("X"))).alias("p")).select("n_nationkey", "p.*")


@query("SELECT page_id, regexp_extract(lower(url), '^(?:[a-z]+://)?(?:www\\.)?([^/?#:]+)', 1) AS host FROM pages")
def url_host(spark, sf_dir):
    return Tables(spark, sf_dir)["pages"].select("page_id", T.host(F.col("url")).alias("host"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def year_of(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    return o.select("o_orderkey", T.year_of(F.concat(F.lit("made in "), F.date_format("o_orderdate", "yyyy"), F.lit(", glass"))).alias("y"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-00' ELSE strftime(o_orderdate, '%Y') || '-00-00' END AS value, CAST(11 - o_orderkey % 3 AS INT) AS precision FROM orders")
def partial_date(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return o.select("o_orderkey", T.partial_date(text).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
def days_until(spark, sf_dir):
    return Tables(spark, sf_dir)["orders"].select("o_orderkey", T.days_until(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date")).alias("days"))


@query("WITH g AS (SELECT CAST(unnest(generate_series(DATE '1995-05-29', DATE '1995-05-29' + 41, INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, month(day) = 6 AS inside, count(o_orderkey) AS n FROM g LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY 1, 2")
def month_grid(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-05-29").cast("date"), F.date_add(F.lit("1995-05-29").cast("date"), 41))).alias("day"))
    own = Tables(spark, sf_dir)["orders"].groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(own, "day", "left").select("day", (F.month("day") == 6).alias("inside"), F.coalesce("n", F.lit(0)).alias("n"))


# --- graph -----------------------------------------------------------------------------------


@query("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.graph_counts(t.nodes, t.edges)


@query("WITH u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), d1 AS (SELECT b AS id FROM u WHERE a = 'nation:3'), d2 AS (SELECT DISTINCT b AS id FROM u JOIN d1 ON a = d1.id WHERE b <> 'nation:3' AND b NOT IN (SELECT id FROM d1)), hit AS (SELECT id, 1 AS distance FROM d1 UNION ALL SELECT id, 2 FROM d2) SELECT nodes.id, label, type, CAST(distance AS INT) AS distance FROM hit JOIN nodes ON nodes.id = hit.id")
def graph_neighbors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.neighbors(t.nodes, t.edges, "nation:3", 2)


@query("SELECT type, CASE WHEN src = 'nation:3' THEN 'out' ELSE 'in' END AS direction, count(DISTINCT CASE WHEN src = 'nation:3' THEN dst ELSE src END) AS n FROM edges WHERE src = 'nation:3' OR dst = 'nation:3' GROUP BY 1, 2")
def graph_neighbor_groups(spark, sf_dir):
    return N.neighbor_groups(Tables(spark, sf_dir).edges, "nation:3")


@query("WITH r AS (SELECT 'region:' || r_regionkey AS id, r_regionkey AS k FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, min(id) OVER (PARTITION BY k) AS root FROM r")
def graph_components(spark, sf_dir):
    return N.components(Tables(spark, sf_dir).edges)


# --- entity resolution -----------------------------------------------------------------------


def _clustered(spark, sf_dir):
    items = Tables(spark, sf_dir).items.withColumn("name", T.norm(F.col("label")))
    return E.pick_canonical(items, ["kind", "name"], [F.asc("n"), F.asc("key")])


@query("SELECT key, kind, first_value(key) OVER (PARTITION BY kind, lower(trim(label)) ORDER BY n, key) AS canonical, count(*) OVER (PARTITION BY kind, lower(trim(label))) AS members FROM items")
def cluster_exact(spark, sf_dir):
    return _clustered(spark, sf_dir).select("key", "kind", "canonical", "members")


@query("WITH c AS (SELECT key, kind, first_value(key) OVER (PARTITION BY kind, lower(trim(label)) ORDER BY n, key) AS canonical FROM items) SELECT canonical, kind, count(*) AS members, coalesce(string_agg(CASE WHEN key <> canonical THEN key END, ',' ORDER BY key), '') AS extra_keys FROM c GROUP BY canonical, kind")
def fold_duplicates(spark, sf_dir):
    return E.fold_duplicates(_clustered(spark, sf_dir))


@query("WITH c AS (SELECT kind, lower(trim(label)) AS name, count(*) AS n FROM items GROUP BY 1, 2) SELECT kind, count(*) AS clusters, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM c WHERE n > 1 GROUP BY kind")
def cluster_report(spark, sf_dir):
    return E.cluster_report(_clustered(spark, sf_dir))


@query("WITH p AS (SELECT key, CASE n % 6 WHEN 0 THEN 'pushed' WHEN 1 THEN 'changed' WHEN 2 THEN 'orphan' WHEN 3 THEN 'failed' WHEN 4 THEN 'new' ELSE 'ready' END AS status, n % 2 = 0 AS has, n % 5 = 0 AS other, n % 11 = 0 AS gone, n % 7 = 0 AS fresh FROM items) SELECT key, CASE WHEN gone THEN CASE WHEN has THEN 'orphan' ELSE 'dropped' END WHEN fresh THEN 'new' WHEN status IN ('pushed', 'changed') THEN CASE WHEN other THEN 'changed' ELSE 'pushed' END WHEN status = 'orphan' THEN CASE WHEN has THEN 'changed' ELSE 'new' END WHEN status = 'failed' AND other THEN CASE WHEN has THEN 'ready' ELSE 'new' END ELSE status END AS status FROM p WHERE NOT (gone AND fresh)")
def change_status(spark, sf_dir):
    items = Tables(spark, sf_dir).items
    status = F.element_at(F.array(*map(F.lit, ("pushed", "changed", "orphan", "failed", "new", "ready"))), (F.col("n") % 6 + 1).cast("int"))
    prev = items.where("n % 7 <> 0").select("key", status.alias("status"), F.sha1("label").alias("content_hash"), F.sha1("label").alias("pushed_hash"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("Q"), "n")).alias("qid"))
    label = F.when(F.col("n") % 5 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label"))
    return E.change_status(prev, items.where("n % 11 <> 0").select("key", F.sha1(label).alias("content_hash")))


# --- streams ---------------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def stream_usage_daily(spark, sf_dir):
    return S.landed(S.daily_usage(S.arrived(spark, f"{sf_dir}/events.parquet")), "daily")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    return S.landed(S.first_seen(S.arrived(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "3650 days"), "seen")


from tessera.plans import comparison, landed, matching, records, relations, staging, streams, tables, workflow  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
