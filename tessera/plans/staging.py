"""Queries on staging: registry tables made from the star schema, staged into items and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import staging as S
from tessera.plans.base import Tables, query

#: In SQL that both engines run.
_TABLES = {
    "artists": "SELECT CAST(c_custkey AS STRING) AS _row_id, concat('Maker ', CAST(c_custkey % 400 AS STRING), ' ', n_name) AS artist_name, CASE n_nationkey % 4 WHEN 0 THEN concat(n_name, ', va') WHEN 1 THEN 'Frankreich/FR' ELSE n_name END AS based_in, CASE WHEN c_custkey % 3 = 0 THEN concat('site', CAST(c_custkey AS STRING), '.example.com') WHEN c_custkey % 7 = 0 THEN 'not a link' END AS website, concat(c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN '; Blown Glass' ELSE '' END) AS tech_primary, CAST(c_acctbal AS STRING) AS phone, c_comment_ AS remark FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS c_comment_ FROM customer) JOIN nation ON c_nationkey = n_nationkey",
    "museum_artists": "SELECT CAST(s_suppkey AS STRING) AS _row_id, concat('maker ', CAST(s_suppkey * 7 % 450 AS STRING), '  ', n_name) AS artist, CASE WHEN s_suppkey % 10 > 0 THEN concat('Museum ', CAST(n_regionkey AS STRING)) ELSE 'n/a' END AS museum FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "studios": "SELECT CAST(s_suppkey AS STRING) AS _row_id, s_name AS name, n_name AS city, CASE s_suppkey % 3 WHEN 0 THEN 'Hot Shop' WHEN 1 THEN 'Other' END AS type, CAST(s_nationkey AS STRING) AS lat, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 180 AS STRING) ELSE '999' END AS lng, concat('since ', CAST(1950 + s_suppkey % 70 AS STRING)) AS founded FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "objects": "SELECT CAST(p_partkey AS STRING) AS _row_id, p_name AS title, concat('maker ', CAST(p_partkey % 500 AS STRING), ' ', n_name) AS maker, CASE WHEN p_partkey % 5 > 0 THEN CAST(1990 + p_partkey % 30 AS STRING) END AS year, CAST(NULL AS STRING) AS techniques, CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size AS STRING), ' x 20 x ', CAST(p_size * 3 AS STRING), ' mm') END AS dimensions, CASE WHEN p_partkey % 9 = 0 THEN concat('h', CAST(p_partkey AS STRING)) END AS content_hash FROM part JOIN nation ON p_partkey % 25 = n_nationkey",
    "lineage": "SELECT CAST(c_custkey AS STRING) AS _row_id, concat('Maker ', CAST(c_custkey % 400 AS STRING), ' ', n_name) AS student_name, concat('MAKER ', CAST((c_custkey + 25) % 400 AS STRING), '  ', n_name) AS mentor_name, CASE WHEN c_custkey % 2 = 0 THEN concat(CAST(1990 + c_custkey % 20 AS STRING), ' to ', CAST(2011 + c_custkey % 5 AS STRING)) END AS years FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 = 0",
}
_SEASONS = "SELECT CAST(year(o_orderdate) AS INT) AS id, concat('Season ', CAST(CAST(year(o_orderdate) AS INT) AS STRING)) AS title, CASE WHEN max(year(o_orderdate)) >= 1998 THEN 'open' ELSE 'closed' END AS status, CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS starts FROM orders GROUP BY CAST(year(o_orderdate) AS INT)"
#: Three forms of a place: a city of a state, a city of a country, and a word that is taken for a city.
_BASED = "CASE WHEN based_in LIKE '%, va' THEN {} WHEN based_in = 'Frankreich/FR' THEN {} ELSE {} END"
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_DUCK = f"""ar AS ({_TABLES["artists"]}), mu AS ({_TABLES["museum_artists"]}), st AS ({_TABLES["studios"]}), ob AS ({_TABLES["objects"]}), li AS ({_TABLES["lineage"]}), se AS ({_SEASONS}),
ppl AS (SELECT 0 AS rank, _row_id AS r, {_NORM.format("artist_name")} AS n, 'reg:artists:' || _row_id AS key FROM ar UNION ALL SELECT 4, _row_id, {_NORM.format("artist")}, 'reg:museum_artists:' || _row_id FROM mu UNION ALL SELECT 41, _row_id, {_NORM.format("maker")}, 'reg:maker:' || {_SLUG.format("maker")} FROM ob),
win AS (SELECT n, key AS winner, rank, r FROM ppl QUALIFY row_number() OVER (PARTITION BY n ORDER BY rank, r, key) = 1),
sv AS (SELECT entry_id, count(*) AS votes FROM votes GROUP BY 1),
re AS (SELECT e.id AS entry_id, e.object_row_id, e.season_id, e.edition_size, e.studio, coalesce(v.votes, 0) AS votes, row_number() OVER (PARTITION BY e.season_id ORDER BY coalesce(v.votes, 0) DESC, e.created_at, e.id) AS n, se.status = 'closed' AS closed, se.starts FROM entries e LEFT JOIN sv v ON v.entry_id = e.id JOIN se ON se.id = e.season_id),
oe AS (SELECT re.*, 'reg:object:' || coalesce(ob.content_hash, ob._row_id) AS key FROM re JOIN ob ON ob._row_id = re.object_row_id),
lx AS (SELECT l._row_id, s.winner AS s, m.winner AS m, l.years FROM li l LEFT JOIN win s ON s.n = {_NORM.format("student_name")} LEFT JOIN win m ON m.n = {_NORM.format("mentor_name")})"""
_ITEMS = f"""WITH {_DUCK},
it AS (SELECT 'reg:artists:' || _row_id AS key, 'person' AS kind, artist_name AS label, 'glass artist, ' || {_BASED.format("replace(based_in, ', va', ', Virginia')", "'Frankreich, France'", "based_in")} AS description, 'reg:class:person' AS cls FROM ar
 UNION ALL SELECT 'reg:museum_artists:' || _row_id, 'person', regexp_replace(artist, ' +', ' ', 'g'), 'glass artist held in museum collections', 'reg:class:person' FROM mu JOIN win ON winner = 'reg:museum_artists:' || _row_id
 UNION ALL SELECT DISTINCT 'reg:museum:' || {_SLUG.format("museum")}, 'museum', museum, 'museum holding glass', 'reg:class:museum' FROM mu WHERE museum <> 'n/a'
 UNION ALL SELECT winner, 'person', maker, 'glass maker', 'reg:class:person' FROM ob JOIN win ON win.r = _row_id AND win.rank = 41 AND win.n = {_NORM.format("maker")}
 UNION ALL SELECT 'reg:studios:' || _row_id, 'studio', name, CASE WHEN type = 'Hot Shop' THEN 'hot shop' ELSE 'glass studio' END || ' in ' || city, CASE WHEN type = 'Hot Shop' THEN 'reg:class:hot-shop' ELSE 'reg:class:studio' END FROM st
 UNION ALL SELECT 'reg:studio:' || {_SLUG.format("studio")}, 'studio', studio, 'glass studio', 'reg:class:studio' FROM oe GROUP BY studio
 UNION ALL SELECT 'reg:object:' || coalesce(content_hash, _row_id), 'object', title, concat_ws(', ', 'glass piece by ' || maker, year), 'reg:class:object' FROM ob
 UNION ALL SELECT 'reg:seasons:' || id, 'season', title, 'collecting event', 'reg:class:season' FROM se
 UNION ALL SELECT 'reg:award:crowd-favourite', 'award', 'Crowd Favourite', 'people''s choice of a collecting event', 'reg:class:award' FROM oe WHERE closed AND n = 1 AND votes > 0 GROUP BY 1
 UNION ALL SELECT * FROM (VALUES ('reg:country:france', 'country', 'France', 'country', 'reg:class:country'), ('reg:country:united-states', 'country', 'United States', 'country', 'reg:class:country'), ('reg:place:virginia-united-states', 'place', 'Virginia', 'United States', 'reg:class:place'), ('reg:place:frankreich-france', 'place', 'Frankreich', 'France', 'reg:class:place'))
 UNION ALL SELECT 'reg:place:' || {_SLUG.format("replace(p, ', va', ' Virginia')")}, 'place', replace(p, ', va', ''), CASE WHEN p LIKE '%, va' THEN 'Virginia, United States' ELSE 'place' END, 'reg:class:place' FROM (SELECT city AS p FROM st UNION SELECT based_in FROM ar WHERE based_in <> 'Frankreich/FR')
 UNION ALL SELECT 'reg:technique:building', 'technique', 'Building', '', 'reg:class:technique' UNION ALL SELECT 'reg:technique:offhand-blown', 'technique', 'Offhand Blown Glass', '', 'reg:class:technique')
SELECT * FROM it"""
_CLAIMS = f"""WITH {_DUCK}, c AS (
 SELECT 'reg:artists:' || _row_id AS key, 'occupation' AS prop, 'reg:occupation:glass-artist' AS value, CAST(NULL AS VARCHAR) AS extra, '' AS quals FROM ar
 UNION ALL SELECT winner, 'occupation', 'reg:occupation:glass-artist', NULL, '' FROM win WHERE winner NOT LIKE 'reg:artists:%'
 UNION ALL SELECT 'reg:artists:' || _row_id, 'work location', 'reg:place:' || {_SLUG.format(_BASED.format("replace(based_in, ', va', ' Virginia')", "'Frankreich France'", "based_in"))}, NULL, '' FROM ar
 UNION ALL SELECT DISTINCT 'reg:place:' || {_SLUG.format("replace(based_in, ', va', ' Virginia')")}, u.p, u.v, NULL, '' FROM ar, LATERAL (SELECT unnest([{{'p': 'country', 'v': 'reg:country:united-states'}}, {{'p': 'located in', 'v': 'reg:place:virginia-united-states'}}]) AS u) WHERE based_in LIKE '%, va'
 UNION ALL SELECT * FROM (VALUES ('reg:place:virginia-united-states', 'country', 'reg:country:united-states', NULL, ''), ('reg:place:frankreich-france', 'country', 'reg:country:france', NULL, ''))
 UNION ALL SELECT 'reg:artists:' || _row_id, 'official website', 'https://' || website, NULL, '' FROM ar WHERE website LIKE 'site%'
 UNION ALL SELECT 'reg:artists:' || _row_id, 'technique', 'reg:technique:building', NULL, '' FROM ar WHERE tech_primary LIKE 'BUILDING%' UNION ALL SELECT 'reg:artists:' || _row_id, 'technique', 'reg:technique:offhand-blown', NULL, '' FROM ar WHERE tech_primary LIKE '%Blown Glass'
 UNION SELECT winner, 'collection', 'reg:museum:' || {_SLUG.format("museum")}, NULL, '' FROM mu JOIN win ON win.n = {_NORM.format("artist")} WHERE museum <> 'n/a'
 UNION ALL SELECT 'reg:studios:' || _row_id, 'instance of', 'reg:class:studio', NULL, '' FROM st WHERE type = 'Hot Shop' UNION ALL SELECT 'reg:studios:' || _row_id, 'located in', 'reg:place:' || {_SLUG.format("city")}, NULL, '' FROM st
 UNION ALL SELECT 'reg:studios:' || _row_id, 'coordinates', format('{{:.5f}},{{:.5f}}', CAST(lat AS DOUBLE), CAST(lng AS DOUBLE)), NULL, '' FROM st WHERE lng <> '999' AND (lat <> '0' OR lng <> '0') UNION ALL SELECT 'reg:studios:' || _row_id, 'inception', founded[7:] || '-00-00', '9', '' FROM st
 UNION ALL SELECT 'reg:object:' || coalesce(content_hash, _row_id), 'title', title, 'en', '' FROM ob UNION ALL SELECT 'reg:object:' || coalesce(content_hash, _row_id), 'maker', winner, NULL, '' FROM ob JOIN win ON win.n = {_NORM.format("maker")}
 UNION ALL SELECT 'reg:object:' || coalesce(content_hash, _row_id), 'inception', year || '-00-00', '9', '' FROM ob WHERE year IS NOT NULL UNION ALL SELECT 'reg:object:' || content_hash, 'content hash', content_hash, NULL, '' FROM ob WHERE content_hash IS NOT NULL
 UNION ALL SELECT 'reg:object:' || coalesce(content_hash, _row_id), u.p, u.v, 'reg:unit:mm', '' FROM ob, LATERAL (SELECT unnest([{{'p': 'width', 'v': split_part(dimensions, ' x ', 1)}}, {{'p': 'depth', 'v': '20'}}, {{'p': 'height', 'v': replace(split_part(dimensions, ' x ', 3), ' mm', '')}}]) AS u) WHERE dimensions IS NOT NULL
 UNION ALL SELECT key, 'participant in', 'reg:seasons:' || season_id, NULL, concat_ws('|', 'point in time=' || starts, CASE WHEN closed THEN 'series ordinal=' || n END) FROM oe
 UNION ALL SELECT key, 'edition size', CAST(edition_size AS VARCHAR), NULL, '' FROM oe UNION ALL SELECT key, 'made at', 'reg:studio:' || {_SLUG.format("studio")}, NULL, '' FROM oe UNION ALL SELECT key, 'award received', 'reg:award:crowd-favourite', NULL, '' FROM oe WHERE closed AND n = 1 AND votes > 0
 UNION ALL SELECT 'reg:seasons:' || id, 'start time', starts, '11', '' FROM se
 UNION ALL SELECT s, 'student of', m, NULL, coalesce('start time=' || years[1:4] || '-00-00|end time=' || years[9:12] || '-00-00', '') FROM lx WHERE s IS NOT NULL AND m IS NOT NULL UNION ALL SELECT m, 'student', s, NULL, coalesce('start time=' || years[1:4] || '-00-00|end time=' || years[9:12] || '-00-00', '') FROM lx WHERE s IS NOT NULL AND m IS NOT NULL)
SELECT DISTINCT * FROM c"""


def _vocab(spark):
    rows = [("technique", "building", "Building", None, None, ""), ("technique", "offhand-blown", "Offhand Blown Glass", ["blown glass"], None, "")]
    return spark.createDataFrame(rows, "kind string, id string, label string, alternatives array<string>, old array<string>, description string")


def _tables(spark, sf_dir: str) -> dict:
    t, out = Tables(spark, sf_dir), {}
    reads = {x: t[x] for x in ("customer", "nation", "supplier", "part", "orders")}
    for name, sql in (_TABLES | {"seasons": _SEASONS}).items():
        for x in reads:
            sql = sql.replace(f"FROM {x}", f"FROM {{{x}}} AS {x}").replace(f"JOIN {x}", f"JOIN {{{x}}} AS {x}")
        out[name] = spark.sql(sql, **{x: df for x, df in reads.items() if f"{{{x}}}" in sql})
    out["objects"] = out["objects"].withColumns({"colour": F.lit(None).cast("string"), "rating": F.lit(None).cast("string"), "events": F.lit(None).cast("array<struct<event_type: string, event_date: string, actor: string, location: string>>")})
    nothing = {c: F.lit(None).cast("string") for c in ("ends", "voting_closes", "theme", "slug")}
    out["seasons"] = out["seasons"].withColumns(nothing)
    out["season_entries"], out["season_votes"] = t.entries.withColumn("status", F.lit("approved")), t.votes
    out["lineage_submissions"] = out.pop("lineage")
    return out


def _staged(spark, sf_dir: str) -> S.Staged:
    return S.stage(_tables(spark, sf_dir), _vocab(spark))


@query(_ITEMS)
def staged_items(spark, sf_dir):
    """Items of artists, museums, studios, makers, pieces, seasons, places, countries and terms."""
    return _staged(spark, sf_dir).items.select("key", "kind", "label", "description", "cls")


@query(_CLAIMS)
def staged_claims(spark, sf_dir):
    """All their claims, with qualifiers as text."""
    quals = F.array_join(F.transform("quals", lambda q: F.concat(q["prop"], F.lit("="), q["value"])), "|")
    return _staged(spark, sf_dir).claims.select("key", "prop", "value", "extra", quals.alias("quals"))


_USED = "list_aggregate(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), 'string_agg', '|')"


@query(
    f"""WITH {_DUCK} SELECT 'artists' AS tbl, count(*) AS rows, count(*) AS items, 'artist_name|based_in|tech_primary|website' AS used, 'remark' AS ignored FROM ar
 UNION ALL SELECT 'museum_artists', (SELECT count(*) FROM mu), count(*), 'artist|museum', '' FROM win WHERE rank = 4
 UNION ALL SELECT 'studios', count(*), count(*), 'city|founded|lat|lng|name|type', '' FROM st
 UNION ALL SELECT 'objects', count(*), count(*), 'content_hash|dimensions|maker|title|year', 'colour|events|rating|techniques' FROM ob
 UNION ALL SELECT 'seasons', count(*), count(*), 'ends|starts|status|theme|title', 'id|slug|voting_closes' FROM se"""
)
def stage_report(spark, sf_dir):
    """Rows, items, columns used and left of each table."""
    out = _staged(spark, sf_dir).report
    return out.where("tbl <> 'lineage_submissions'").select("tbl", "rows", "items", F.array_join("used", "|").alias("used"), F.array_join("ignored", "|").alias("ignored"))


@query(f"WITH {_DUCK} SELECT _row_id AS row, CASE WHEN s IS NULL THEN 'student' ELSE 'mentor' END AS missing FROM lx WHERE s IS NULL OR m IS NULL")
def lineage_held(spark, sf_dir):
    """Lineage rows whose student or mentor nobody is known by."""
    return _staged(spark, sf_dir).held.select("row", F.split("why", " ")[0].alias("missing"))


@query(f"WITH {_DUCK} SELECT entry_id, object_row_id AS object_id, 'reg:seasons:' || season_id AS season, CASE WHEN closed THEN n END AS rank, closed AND n = 1 AND votes > 0 AS won, votes FROM re")
def season_results(spark, sf_dir):
    """Entries of all seasons by votes; ranks and winners of closed ones."""
    t = _tables(spark, sf_dir)
    return S.season_results(t["seasons"], t["season_entries"], t["season_votes"]).select("entry_id", "object_id", "season", "rank", "won", "votes")
