"""Queries on tables: catalogs, imports, filters, privacy, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import tables as R
from tessera.plans.base import Tables, query


@query("SELECT 'customer' AS tbl, 'people' AS domain, 'public' AS visibility, count(*) AS n_rows FROM customer UNION ALL SELECT 'part', 'things', 'restricted', count(*) FROM part")
def registry_datasets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.build_registry(spark, {"customer": (t["customer"], "people", "public"), "part": (t["part"], "things", "restricted")})[0]


@query("WITH d AS (SELECT 'orders' AS tbl, 'public' AS visibility UNION ALL SELECT 'part', 'public' UNION ALL SELECT 'customer', 'restricted') SELECT tbl, visibility, n AS n_approved FROM d JOIN (SELECT tbl, count(*) AS n FROM approvals WHERE status = 'approved' GROUP BY 1) USING (tbl) WHERE visibility = 'public'")
def visible_datasets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sets = R.build_registry(spark, {n: (t[n], "d", v) for n, v in (("orders", "public"), ("part", "public"), ("customer", "restricted"))})[0]
    return R.visible_datasets(sets.select("tbl", "visibility"), t.approvals)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def public_columns(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select("c_custkey", "c_mktsegment", F.col("c_name").alias("contact_name"), F.col("c_acctbal").alias("phone"))
    return R.public_columns(c)


@query("SELECT c_custkey, c_mktsegment, c_nationkey AS born_and_reside_country FROM customer")
def privacy_project(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select("c_custkey", "c_mktsegment", F.col("c_name").alias("artist_name"), F.col("c_acctbal").alias("birth_year"), F.col("c_nationkey").alias("born_and_reside_country"), F.lit("x").alias("gender"))
    return R.privacy_project(c)


def _sheet(spark, sf_dir):
    """Orders, and a sheet: known ids with new and blank cells, some of them twice, new ids whose first row is blank, blank ones, and rows without id."""
    base = Tables(spark, sf_dir).rows_.select("_row_id", "o_orderpriority", F.lit("kept").alias("_note"))
    k = F.col("_row_id").cast("long")
    put = lambda where, id_, value, part: base.where(where).select(id_.alias("_row_id"), value.alias("o_orderpriority"), F.lit("x").alias("foreign"), F.lit("lost").alias("_note"), (k * 10 + part).alias("seq"))
    none = F.lit(None).cast("string")
    sheet = put(k % 7 == 0, F.concat(F.lit(" "), "_row_id"), F.when(k % 5 == 0, "  ").otherwise("new"), 1).unionByName(put(k % 21 == 0, F.col("_row_id"), F.lit("again"), 2))
    sheet = sheet.unionByName(put(k % 50 == 0, F.concat(F.lit("n"), "_row_id"), none, 3)).unionByName(put(k % 50 == 0, F.concat(F.lit("n"), "_row_id"), F.lit("new"), 4))
    return base, sheet.unionByName(put(k % 60 == 0, F.concat(F.lit("b"), "_row_id"), F.lit(""), 5)).unionByName(put(k % 80 == 0, F.lit(" "), F.lit("loose"), 6))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS _row_id, CASE WHEN o_orderkey % 21 = 0 THEN 'again' WHEN o_orderkey % 35 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS o_orderpriority, 'kept' AS _note FROM orders UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), 'new', NULL FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'own', 'loose', NULL FROM orders WHERE o_orderkey % 80 = 0")
def import_sheet(spark, sf_dir):
    base, sheet = _sheet(spark, sf_dir)
    out = R.import_csv(base, sheet, order="seq")[0]
    return out.withColumn("_row_id", F.when(F.col("o_orderpriority") == "loose", "own").otherwise(F.col("_row_id")))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 = 0) + count(*) FILTER (WHERE o_orderkey % 21 = 0) AS updated, count(*) FILTER (WHERE o_orderkey % 50 = 0) + count(*) FILTER (WHERE o_orderkey % 80 = 0) AS added, count(*) FILTER (WHERE o_orderkey % 50 = 0) + count(*) FILTER (WHERE o_orderkey % 60 = 0) AS skipped FROM orders")
def import_report(spark, sf_dir):
    return R.import_csv(*_sheet(spark, sf_dir), order="seq")[1]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'approved' AS status FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), 'approved' FROM orders WHERE o_orderkey % 50 = 0")
def import_approvals(spark, sf_dir):
    base, sheet = _sheet(spark, sf_dir)
    return R.import_csv(base, sheet.where("trim(_row_id) <> ''"), order="seq")[2]


@query("SELECT p_partkey, 'pending' AS status, p_type || ' | ' || p_brand AS tags FROM part UNION ALL SELECT -1 - p_partkey, 'approved', p_type FROM part")
def append_submissions(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"]
    base = p.select((-1 - F.col("p_partkey")).alias("p_partkey"), F.lit("approved").alias("status"), F.col("p_type").alias("tags"))
    return R.append_submissions(base, p.select("p_partkey", F.array("p_type", "p_brand").alias("tags")), ("tags",))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0 AND (contains(lower(c_name), '1') OR false)")
def facet_filter(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_nationkey") % 3 == 0, "x").alias("grid_glass"), F.lit("").alias("grid_wood"))
    return R.facet_filter(c, {"c_mktsegment": "BUILDING"}, {"grid": ["grid_glass", "grid_wood"]}, "1").select("c_custkey")


@query("SELECT event_id AS session FROM events WHERE event_type = 'click' AND user_id = 8 AND ts >= TIMESTAMP '2024-01-02' AND contains(props, '7')")
def filter_sessions(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"].select(F.col("event_id").alias("session"), F.col("props").alias("device"), F.col("event_type").alias("kind"), F.col("user_id").alias("uid"), F.col("ts").alias("created_at"), F.lit("s").alias("q"))
    e = e.withColumn("session_", F.col("session")).withColumn("session", F.lit(""))
    return R.filter_sessions(e, "7", "2024-01-02", kind="click", uid=8, decision=None).select(F.col("session_").alias("session"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey % 2 = 0)")
def consented(spark, sf_dir):
    t = Tables(spark, sf_dir)
    owners = t["customer"].select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, "approved").otherwise("pending").alias("status"), F.when(F.col("c_nationkey") % 2 == 0, " Yes").otherwise("no").alias("consent"))
    return R.consented(t["orders"], owners, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey * 2 = o_custkey")
def with_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    look = t["customer"].withColumn("o_custkey", F.col("c_custkey") * 2)
    return R.with_lookup(t["orders"], look, "o_custkey", ["c_name", "c_mktsegment"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def distinct_by_content(spark, sf_dir):
    d = Tables(spark, sf_dir)["documents"].where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.distinct_by(d, "h", [F.asc("doc_id")]).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def parts_never_sold_in_bulk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.minus(t["part"], t["lineitem"].where("l_quantity >= 49").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey").select("p_partkey")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 2 AS INT) AS part FROM orders")
def interleaved_split(spark, sf_dir):
    return R.interleave(Tables(spark, sf_dir)["orders"], "o_custkey", "o_orderkey", 2).select("o_orderkey", "part")


@query("SELECT c_custkey, array_to_string(list_sort(list_intersect([c_mktsegment, 'A', 'B'], ['A', 'BUILDING'])), ',') AS both, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment || ',B' END AS only_a FROM customer")
def label_sets(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select("c_custkey", F.array("c_mktsegment", F.lit("A"), F.lit("B")).alias("a"), F.array(F.lit("A"), F.lit("BUILDING")).alias("b"))
    return R.label_sets(c, "a", "b").select("c_custkey", F.array_join(F.array_sort("both"), ",").alias("both"), F.array_join("only_a", ",").alias("only_a"))


@query("SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(CAST(c_custkey % 100 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) || ']},\"properties\":{\"c_name\":\"' || c_name || '\"}}' AS feature FROM customer WHERE NOT (c_custkey % 100 = 0 AND c_nationkey = 0)")
def geojson(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select("c_name", F.col("c_nationkey").cast("string").alias("lat"), (F.col("c_custkey") % 100).cast("string").alias("lng"))
    return R.geojson(c, "lat", "lng", ["c_name"])


@query(r"""SELECT o_orderkey AS id, array_to_string(['BEGIN:VEVENT', 'UID:' || o_orderkey || '@registry.example', 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(CAST(o_orderdate AS DATE) + 1, '%Y%m%d'),
 'SUMMARY:A\\b\,  c\; ' || o_orderpriority || '\nnext', 'DESCRIPTION:' || repeat('x', 60) || chr(13) || chr(10) || ' ' || repeat('x', 40), 'TRANSP:TRANSPARENT', 'END:VEVENT'], chr(13) || chr(10)) AS entry FROM orders""")
def ics_events(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("id"), F.concat(F.lit("A\\b,  c; "), "o_orderpriority", F.lit("\nnext")).alias("title"), F.to_date("o_orderdate").alias("starts"), F.lit(None).cast("date").alias("ends"), F.repeat(F.lit("x"), F.lit(100)).alias("description"))
    return R.ics_events(o)


@query("WITH e AS (SELECT src, type, '[' || string_agg('\"' || dst || '\"', ',' ORDER BY dst) || ']' AS ids FROM (SELECT DISTINCT * FROM edges) GROUP BY 1, 2) SELECT n.id, '{\"@id\":\"' || n.id || '\",\"@type\":\"' || n.type || '\",\"name\":\"' || label || '\"' || CASE WHEN ids IS NULL THEN '' ELSE ',\"links\":{\"' || e.type || '\":' || ids || '}' END || '}' AS document FROM nodes n LEFT JOIN e ON n.id = src")
def jsonld(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.jsonld(t.nodes, t.edges)


@query("SELECT count(*) AS points, count(DISTINCT c_nationkey) AS countries, count(DISTINCT c_mktsegment) AS kinds FROM customer WHERE c_custkey % 300 BETWEEN 0 AND 90 AND NOT (c_custkey % 300 = 0 AND c_nationkey = 0)")
def map_summary(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select((F.col("c_custkey") % 300).cast("string").alias("lat"), F.col("c_nationkey").alias("lng"), F.col("c_nationkey").cast("string").alias("country"), "c_mktsegment")
    return R.map_summary(c, "lat", "lng", "country", "c_mktsegment")


@query("SELECT count(DISTINCT user_id) AS people, CAST(sum(event_id) AS BIGINT) AS bytes, max(ts) AS last, count(*) FILTER (WHERE event_type = 'click') AS with_mat FROM events")
def people_and_bytes(spark, sf_dir):
    e = Tables(spark, sf_dir)["events"]
    return R.people_and_bytes(e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("bytes"), F.col("ts").alias("created_at"), (F.col("event_type") == "click").alias("has_mat")))


@query("SELECT CAST(sum(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 10 END) AS DOUBLE) AS firings, 0.0 AS cost FROM supplier")
def studio_totals(spark, sf_dir):
    s = Tables(spark, sf_dir)["supplier"].select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise("n/a").alias("firings"), F.lit("10").alias("kiln_runs"))
    return R.studio_totals(s, {"firings": ["firings", "kiln_runs"], "cost": ["cost", "total_cost"]})


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS named, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN 'TBD' ELSE 'Ana ' || c_custkey END AS cleaned FROM customer")
def names_checked(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 3, F.lit(" N/A ")).when(k % 4 == 2, F.lit("TBD")).otherwise(F.concat(F.lit("Ana "), k.cast("string")))
    return Tables(spark, sf_dir)["customer"].select("c_custkey", T.looks_like_name(raw).alias("named"), T.clean_blank(raw).alias("cleaned"))


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) END AS height, length(p_name || ' ' || p_name) > 12 AS long, left(p_name || ' ' || p_name, 11) AS head FROM part")
def measures_and_clips(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"]
    clip = T.clip(F.concat("p_name", F.lit("   "), "p_name"), 12)
    full = F.concat("p_name", F.lit(" "), "p_name")
    return p.select("p_partkey", T.height_mm(F.concat(F.lit("10 × 2.5 x "), F.col("p_size").cast("string"), F.lit(" mm"))).alias("height"), F.endswith(clip, F.lit("…")).alias("long"), F.left(full, F.lit(11)).alias("head"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS _row_id FROM orders WHERE o_orderkey % 4 = 0")
def get_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.get_rows(t.rows_, t.rows_.where("cast(_row_id AS long) % 4 = 0").unionAll(t.rows_.where("cast(_row_id AS long) % 8 = 0"))).select("_row_id")


@query("SELECT p_partkey, ['red', 'green', 'blue', 'neutral', 'black', 'orange', 'pink', 'cool', 'neutral', 'warm', '', 'pink'][CAST(p_partkey % 12 AS INT) + 1] AS family FROM part")
def colour_families(spark, sf_dir):
    names = F.array(*map(F.lit, ("#ff0000", "#0f0", "0000ff", "#ffffff", "#050505", "#ffa500", "#ff2080", "Cobalt blue", "smoke", "amber", "", "FF00FF")))
    return Tables(spark, sf_dir)["part"].select("p_partkey", T.colour_family(F.get(names, (F.col("p_partkey") % 12).cast("int"))).alias("family"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Pixel 8 · Android 14 · Chrome · 1920×1080' WHEN 1 THEN 'iPhone · iOS 17.2 · Safari' WHEN 2 THEN 'Mac · Firefox · 640×480' ELSE '' END AS line FROM customer")
def device_lines(spark, sf_dir):
    k = F.col("c_custkey") % 4
    ua = F.when(k == 0, "Mozilla/5.0 (Linux; Android 14; Pixel 8; wv) Chrome/120 Safari/537").when(k == 1, "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Safari/604").when(k == 2, "Mozilla/5.0 (Macintosh; Intel) Firefox/120")
    width, height = F.when(k == 0, 1920).when(k == 2, 640), F.when(k == 0, 1080).when(k == 2, 480)
    return Tables(spark, sf_dir)["customer"].select("c_custkey", T.device_line(ua, width, height).alias("line"))


@query("SELECT p_partkey, round(greatest(abs(p_size - 20) / greatest(p_size, 20), CASE WHEN p_partkey % 2 = 0 THEN 0.1 END), 3) AS difference, round(greatest(abs(p_size - 20) / greatest(p_size, 20), CASE WHEN p_partkey % 2 = 0 THEN 0.1 END), 3) <= 0.25 AS ok FROM part WHERE p_size > 0")
def size_checks(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"].where("p_size > 0")
    tall = F.when(F.col("p_partkey") % 2 == 0, F.lit(9.0))
    return p.select("p_partkey", T.size_check(F.col("p_size"), tall, F.lit(20), F.lit(10.0)).alias("s")).select("p_partkey", "s.*")


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey)) AS bits, greatest(0, least(1, (22 - bit_count(xor(o_orderkey, o_custkey))) / 16)) AS sim FROM orders")
def hash_distances(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"]
    bits = V.hamming(F.array(F.lit(0), F.col("o_orderkey").cast("int")), F.array(F.lit(0), F.col("o_custkey").cast("int")))
    return o.select("o_orderkey", bits.alias("bits"), V.dhash_sim(bits).alias("sim"))
