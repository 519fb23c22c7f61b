"""Queries on the built graph and on entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import commitments as C
from tessera.operators import graph as N
from tessera.operators import resolution as E
from tessera.plans.base import Tables, query

_N = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_GRAPH = f"""sub AS (SELECT 'artist:' || {_N.format("name")} AS id, * EXCLUDE (id) FROM people WHERE CAST(id AS INT) % 2 = 0), dir AS (SELECT 'artist:' || {_N.format("name")} AS id, name, split_part(techniques, ',', 1) AS technique, bio FROM people WHERE CAST(id AS INT) % 2 = 1),
 o AS (SELECT 'object:' || id AS id, title, techniques, maker, CASE WHEN CAST(id AS INT) % 10 = 0 THEN 'near  SUPPLIER#00000000' || CAST(id AS INT) % 7 || ' yard' END AS place FROM pieces), li AS (SELECT 'artist:' || {_N.format("name")} AS id, 'artist:' || {_N.format("mentor")} AS dst, name, mentor FROM people WHERE {_N.format("name")} <> {_N.format("mentor")}),
 art AS (SELECT id FROM sub UNION SELECT id FROM dir UNION SELECT 'artist:' || {_N.format("maker")} FROM o UNION SELECT id FROM li UNION SELECT dst FROM li), sh AS (SELECT DISTINCT 'studio:' || {_N.format("name")} AS id, {_N.format("name")} AS k FROM studios_),
 uses AS (SELECT id AS src, 'technique:' || {_N.format("techniques")} AS dst FROM sub UNION SELECT id, 'technique:' || {_N.format("technique")} FROM dir UNION SELECT id, 'technique:' || {_N.format("techniques")} FROM o),
 held AS (SELECT DISTINCT 'object:' || object_id AS src, 'collector:' || collector_uid AS dst FROM found_by WHERE status IN ('verified', 'approved')),
 e AS (SELECT src, dst, 'uses' AS type, 'structured' AS sure FROM uses UNION ALL SELECT id, 'artist:' || {_N.format("maker")}, 'made_by', 'structured' FROM o UNION ALL SELECT o.id, sh.id, 'based_at', 'event' FROM o JOIN sh ON contains({_N.format("place")}, k)
  UNION ALL SELECT id, dst, 'studied_under', 'structured' FROM li UNION ALL SELECT sub.id, art.id, 'studied_under', 'text' FROM sub JOIN art ON length(art.id) >= 12 AND contains(lower(bio), art.id[8:]) UNION ALL SELECT t.id, sh.id, 'based_at', 'text' FROM (SELECT id, bio FROM sub UNION ALL SELECT id, bio FROM dir) t JOIN sh ON contains(lower(bio), k)
  UNION ALL SELECT src, dst, 'collected_by', 'structured' FROM held WHERE src IN (SELECT id FROM o)),
 ge AS (SELECT src, dst, type, min(CASE sure WHEN 'structured' THEN 0 WHEN 'event' THEN 1 ELSE 3 END) AS k FROM e WHERE src <> dst GROUP BY 1, 2, 3)"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    people = t.people.withColumn("text", F.col("bio"))
    even = F.col("id").cast("int") % 2 == 0
    place = F.concat(F.lit("near  SUPPLIER#00000000"), (F.col("id").cast("int") % 7).cast("string"), F.lit(" yard"))
    pieces = t.pieces.withColumn("locations", F.when(F.col("id").cast("int") % 10 == 0, F.array(place)))
    lineage = t.people.select(F.col("name").alias("student"), "mentor", F.lit("Apprenticed").alias("relation"))
    return N.build_graph(people.where(even).withColumn("studied_under", F.col("bio")), people.where(~even).withColumn("technique", F.split("techniques", ",")[0]), t.studios_, pieces, lineage, t.found_by)


@query(f"WITH {_GRAPH} SELECT src, dst, type, CASE k WHEN 0 THEN 'structured' WHEN 1 THEN 'event' ELSE 'text' END AS confidence, CASE WHEN type = 'studied_under' AND k = 0 THEN 'Apprenticed' END AS relation FROM ge")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].drop("weight")


@query(f"WITH {_GRAPH}, ends AS (SELECT src AS id FROM ge UNION SELECT dst FROM ge) SELECT type, count(*) AS n FROM (SELECT id, 'artist' AS type FROM art UNION ALL SELECT id, 'object' FROM o UNION ALL SELECT id, 'studio' FROM sh WHERE id IN (SELECT id FROM ends) UNION ALL SELECT DISTINCT dst, 'technique' FROM uses UNION ALL SELECT DISTINCT dst, 'collector' FROM held WHERE src IN (SELECT id FROM o)) GROUP BY 1")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].groupBy("type").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT DISTINCT unnest(['nation:3', 'Supplier#000000007', 'NATION_1', '0000011', 'region', 'no such node']) AS ref), h AS (SELECT ref, id, CASE WHEN id = ref THEN 0 WHEN lower(label) = lower(ref) THEN 1 ELSE 2 END AS how, label FROM q JOIN nodes ON id = ref OR contains(lower(label), lower(ref))) SELECT ref, id FROM h QUALIFY row_number() OVER (PARTITION BY ref ORDER BY how, length(label), id) = 1")
def resolve_nodes(spark, sf_dir):
    refs = spark.createDataFrame([(x,) for x in ("nation:3", "Supplier#000000007", "NATION_1", "0000011", "region", "no such node")], "ref string")
    return N.resolve_nodes(Tables(spark, sf_dir).nodes, refs)


@query("WITH p AS (SELECT 'nation:' || c_nationkey AS b, 'region:' || n_regionkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 5), ids AS (SELECT unnest(['customer:5', b, c]) AS id, unnest([0, 1, 2]) AS step FROM p) SELECT CAST(step AS INT) AS step, id, label, type FROM ids JOIN nodes USING (id)")
def shortest_path(spark, sf_dir):
    t = Tables(spark, sf_dir)
    region = t["customer"].where("c_custkey = 5").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return N.shortest_path(t.nodes, t.edges, "customer:5", f"region:{region}")


@query("WITH n AS (SELECT s_suppkey AS name_id, lower(s_name) AS n FROM supplier), d AS (SELECT id, lower(bio) AS t FROM people) SELECT d.id, n.name_id FROM d JOIN n ON contains(d.t, n.n)")
def text_mentions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.text_mentions(t.people.select("id", F.col("bio").alias("text")), t["supplier"].select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name")))


_KEYED = "k AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name FROM items), named AS (SELECT *, CASE WHEN kind IN ('person', 'studio') THEN concat_ws('|', kind, CASE WHEN kind = 'studio' THEN city ELSE '' END, array_to_string(list_sort(string_split(name, ' ')), ' ')) ELSE key END AS g FROM k)"


@query(f"WITH {_KEYED} SELECT key, min(key) OVER (PARTITION BY g) AS cluster FROM named")
def cluster_items(spark, sf_dir):
    return E.cluster_items(Tables(spark, sf_dir).items).select("key", "cluster")


#: Every item of the link or of its name belongs to one group; studios' names are their own, persons share names, and links join the two.
@query(f"WITH RECURSIVE {_KEYED}, l AS (SELECT key, CASE WHEN kind = 'studio' AND n % 3 = 0 THEN 'web:' || city END AS link FROM items), e AS (SELECT DISTINCT a.key AS a, b.first AS b FROM named a JOIN (SELECT g, min(key) AS first FROM named GROUP BY 1) b USING (g) UNION SELECT l.key, m.first FROM l JOIN (SELECT link, min(key) AS first FROM l WHERE link IS NOT NULL GROUP BY 1) m USING (link)), ed AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS key, a AS pos FROM ed UNION SELECT w.key, ed.b FROM w JOIN ed ON w.pos = ed.a) SELECT key, min(pos) AS cluster FROM w GROUP BY 1")
def cluster_by_links(spark, sf_dir):
    items = Tables(spark, sf_dir).items
    links = items.where("kind = 'studio' AND n % 3 = 0").select("key", F.concat(F.lit("web:"), "city").alias("link"))
    return E.cluster_items(items, links).select("key", "cluster")


@query("SELECT 'reg:person:' || c_custkey AS key, min('reg:person:' || c_custkey) OVER (PARTITION BY c_custkey % 700) AS cluster FROM customer")
def near_name_clusters(spark, sf_dir):
    """Names with and without one more word: near, unlike those that share all words but a number."""
    label = F.concat(F.lit("Maker Long Name Number "), (F.col("c_custkey") % 700).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " b").otherwise(""))
    people = Tables(spark, sf_dir)["customer"].select(F.concat(F.lit("reg:person:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("person").alias("kind"), label.alias("label"), F.lit("").alias("city"))
    return E.cluster_items(people).select("key", "cluster")


@query("WITH l AS (SELECT DISTINCT lower(c_name) AS n, min(c_custkey) AS key FROM customer GROUP BY 1), r AS (SELECT lower(s_name) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1) SELECT key, s FROM l LEFT JOIN r ON replace(l.n, 'customer', 'supplier') = r.n")
def match_by_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = t["customer"].select(F.col("c_custkey").alias("key"), F.concat(F.lit(" SUPPLIER#"), F.right("c_name", F.lit(9))).alias("name"))
    return E.match_by_name(left, t["supplier"].select(F.col("s_suppkey").alias("s"), "s_name"), "name", "s_name", [F.asc("s")]).select("key", "s")


@query("WITH a AS (SELECT c_mktsegment AS name, count(*) AS x, 0 AS y FROM customer GROUP BY 1 UNION ALL SELECT upper(p_type), 0, count(*) FROM part GROUP BY 1) SELECT lower(name) AS k, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM a GROUP BY 1")
def merge_by_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t["customer"].groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("x"))
    b = t["part"].groupBy(F.concat(F.lit("  "), F.lower("p_type")).alias("name")).agg(F.count("*").alias("y"))
    return E.merge_by_name([a, b]).select(F.lower(F.trim("name")).alias("k"), "x", "y")


@query("WITH i AS (SELECT s_suppkey AS index_id, lower(s_name) AS n FROM supplier UNION SELECT s_suppkey, 'nation_' || s_nationkey FROM supplier), q AS (SELECT n_nationkey AS key, lower(n_name) AS n FROM nation UNION SELECT n_nationkey, 'supplier#' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 9, '0') FROM nation WHERE n_nationkey > 20), h AS (SELECT key, count(DISTINCT index_id) AS n, min(index_id) AS first FROM q JOIN i USING (n) GROUP BY 1) SELECT n_nationkey AS key, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'unsure' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN first END AS index_id FROM nation LEFT JOIN h ON key = n_nationkey")
def alias_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = t["nation"].select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") > 20, F.array(F.concat(F.lit("Supplier#"), F.lpad((F.col("n_nationkey") * 7).cast("string"), 9, "0")))).alias("aliases"))
    index = t["supplier"].select(F.col("s_suppkey").alias("index_id"), F.col("s_name").alias("label"), F.array(F.concat(F.lit("Nation_"), "s_nationkey")).alias("aliases"))
    return E.alias_match(people, index)


@query("SELECT query, CAST(1 AS INT) AS rank, 'reg:studio:' || s_suppkey AS key, 100.0 AS score, true AS match FROM supplier JOIN (SELECT DISTINCT s_name AS query FROM supplier) ON query = s_name")
def reconcile_exact(spark, sf_dir):
    items = Tables(spark, sf_dir).items.where("kind = 'studio'").select("key", "label", F.lit(None).cast("array<string>").alias("aliases"))
    return E.reconcile(items.select(F.col("label").alias("query")), items, top=1)


@query("SELECT key, CASE WHEN n % 5 = 0 THEN 'missing' WHEN n % 7 = 0 THEN 'label' WHEN n % 3 = 0 THEN 'added' ELSE 'ok' END AS drift FROM items")
def drift_report(spark, sf_dir):
    items = Tables(spark, sf_dir).items.select("key", "label", "n", F.array("kind", "city").alias("claims"))
    theirs = items.where("n % 5 <> 0").select("key", F.when(F.col("n") % 7 == 0, F.upper(F.concat("label", F.lit("?")))).otherwise(F.col("label")).alias("label"), F.when(F.col("n") % 3 == 0, F.concat("claims", F.array(F.lit("more")))).otherwise(F.slice("claims", 1, 1)).alias("claims"))
    return E.drift_report(items, theirs)


@query("WITH p AS (SELECT key, unnest(CASE WHEN city <> '' THEN ['kind', 'located in'] ELSE ['kind'] END) AS p FROM items) SELECT p, count(*) AS n, count(DISTINCT key) AS n_items FROM p GROUP BY 1")
def property_usage(spark, sf_dir):
    claim = lambda p, v: F.struct(F.lit(p).alias("p"), F.col(v).alias("v"))
    items = Tables(spark, sf_dir).items.withColumn("claims", F.when(F.col("city") != "", F.array(claim("kind", "kind"), claim("located in", "city"))).otherwise(F.array(claim("kind", "kind"))))
    return E.property_usage(items)


@query("SELECT key, CASE WHEN n % 13 = 0 THEN 'skip-unresolved' WHEN n % 2 = 0 AND n % 5 = 0 THEN 'skip-exists' WHEN n % 2 = 0 THEN 'create' WHEN n % 3 = 0 THEN 'skip-current' ELSE 'update' END AS action FROM items")
def write_plan(spark, sf_dir):
    items = Tables(spark, sf_dir).items
    plan = items.select("key", F.when(F.col("n") % 2 == 1, F.concat(F.lit("Q"), "n")).alias("qid"), F.lit("h").alias("content_hash"), F.when(F.col("n") % 3 == 0, "h").alias("pushed_hash"), F.when(F.col("n") % 13 == 0, F.array(F.lit("reg:none:0"))).when(F.col("n") % 4 == 0, F.array("key")).otherwise(F.array().cast("array<string>")).alias("refs"), F.lit(None).cast("string").alias("canonical"))
    return E.write_plan(plan, items.where("n % 5 = 0").select("key", F.lit("Q").alias("qid")))


@query("SELECT key, upper(label) AS label, CASE WHEN n % 3 = 0 THEN 'kind' WHEN n % 2 = 0 THEN 'kind,located in,website' ELSE 'kind,located in' END AS props FROM items")
def apply_review(spark, sf_dir):
    claim = lambda p, v: F.struct(F.lit(p).alias("p"), v.alias("v"))
    items = Tables(spark, sf_dir).items
    full = items.select("key", F.lower("label").alias("label"), F.lit("d").alias("description"), F.array("label").alias("aliases"), F.array(claim("kind", F.col("kind")), claim("located in", F.col("city"))).alias("claims"))
    review = items.select("key", F.upper("label").alias("label"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("aliases"), F.when(F.col("n") % 3 == 0, F.array(F.lit("located in"))).alias("drop"), F.when((F.col("n") % 2 == 0) & (F.col("n") % 3 != 0), F.array(claim("website", F.lit("w")), claim("website", F.lit("w")))).alias("add"))
    out = E.apply_review(full, review)
    return out.select("key", "label", F.array_join(F.transform("claims", lambda c: c["p"]), ",").alias("props"))


@query("WITH f AS (SELECT c_custkey AS key, s_suppkey AS candidate, c_nationkey = s_nationkey AS near FROM customer JOIN supplier ON right(c_name, 2) = right(s_name, 2)), b AS (SELECT key, candidate FROM f WHERE near), o AS (SELECT key, count(DISTINCT candidate) AS n, min(candidate) AS first FROM b GROUP BY 1) SELECT DISTINCT f.key, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'unsure' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN first END AS candidate FROM f LEFT JOIN o USING (key)")
def decide_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, s = t["customer"].withColumn("k", F.right("c_name", F.lit(2))), t["supplier"].withColumn("k", F.right("s_name", F.lit(2)))
    found = c.join(s, "k").select(F.col("c_custkey").alias("key"), F.lit("Same Name").alias("label"), F.col("s_suppkey").alias("candidate"), F.lit("same  name").alias("name"), (F.col("c_nationkey") == F.col("s_nationkey")).alias("nation"))
    return E.decide_links(found, ["nation"])


@query("WITH i AS (SELECT key, n, CASE WHEN n % 4 = 1 AND n > 0 THEN 'p:' || kind END AS canonical FROM items), s AS (SELECT * FROM i WHERE canonical IS NOT NULL AND n % 3 = 0) SELECT key, CASE WHEN n % 4 = 1 AND n % 3 = 0 AND n > 0 THEN 'split' ELSE 'new' END AS status FROM items")
def apply_splits(spark, sf_dir):
    items = Tables(spark, sf_dir).items
    folded = items.select("key", F.lit("new").alias("status"), F.when((F.col("n") % 4 == 1) & (F.col("n") > 0), F.concat(F.lit("p:"), "kind")).alias("canonical"), F.lit(None).cast("string").alias("qid"), F.array().cast("array<string>").alias("different"))
    return E.apply_splits(folded, items.where("n % 3 = 0").select("key")).select("key", "status")


@query("SELECT key, CASE WHEN n % 5 = 0 THEN 'known' WHEN n % 3 = 0 THEN 'decided' WHEN n % 2 = 0 AND n % 7 <> 0 THEN 'checked' ELSE 'ask' END AS step FROM items WHERE n % 11 <> 0")
def select_to_check(spark, sf_dir):
    n = F.col("n")
    items = Tables(spark, sf_dir).items
    own = items.select("key", "label", F.when(n % 11 == 0, "skipped").otherwise("new").alias("status"), F.when(n % 5 == 0, "Q1").alias("qid"))
    decided = items.where("n % 3 = 0 OR n % 2 = 0").select("key", F.when(n % 7 == 0, F.lit("old")).otherwise(F.col("label")).alias("label"), F.when(n % 3 == 0, "rejected").otherwise("none").alias("status"), F.lit("").alias("qid"))
    return E.select_to_check(own, decided)


@query("SELECT n AS key, CASE n % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'instagram' ELSE 'city' END AS field, CASE n % 3 WHEN 0 THEN 'https://x.org/' || n WHEN 1 THEN 'user_' || n ELSE 'Rome' END AS value, CASE n % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS confidence FROM items WHERE kind = 'person' AND NOT (n % 3 = 0 AND n % 2 = 0)")
def valid_proposals(spark, sf_dir):
    n = F.col("n")
    value = F.when(n % 3 == 0, F.when(n % 2 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://x.org/"), n))).when(n % 3 == 1, F.concat(F.lit("https://www.instagram.com/user_"), n, F.lit("/"))).otherwise(F.lit(" Rome "))
    sure = F.when(n % 3 == 0, "7").when(n % 3 == 1, "0.5").otherwise("none")
    kind = F.when(n % 3 == 0, "website").when(n % 3 == 1, "instagram").otherwise("city")
    return E.valid_proposals(Tables(spark, sf_dir).items.where("kind = 'person'").select(n.alias("key"), kind.alias("field"), value.alias("value"), sure.alias("confidence")))


@query("SELECT l_suppkey AS person, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS anchors FROM lineitem WHERE l_partkey % 10 = 0 AND l_suppkey % 3 <> 0 AND l_suppkey % 7 <> 0 GROUP BY 1")
def near_anchors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    links = t["lineitem"].select(F.col("l_suppkey").alias("person"), F.concat(F.lit("Name "), "l_suppkey").alias("name"), F.col("l_partkey").cast("string").alias("to"))
    ours = t["supplier"].where("s_suppkey % 3 = 0 OR s_suppkey % 7 = 0").select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).otherwise(-1).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("NAME  "), "s_suppkey")).alias("name"))
    return E.near_anchors(links, t["part"].where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("id")), ours)


@query("SELECT count(*) FILTER (WHERE n % 2 = 0) AS edited, count(*) FILTER (WHERE n % 3 = 0) AS merged, count(*) FILTER (WHERE n % 5 = 0) AS unknown FROM items")
def review_import(spark, sf_dir):
    items, n = Tables(spark, sf_dir).items, F.col("n")
    own = items.select("key", "label", F.lit("d").alias("description"), F.lit(None).cast("string").alias("canonical"), F.lit("new").alias("status"))
    sheet = items.select("key", F.when(n % 2 == 0, F.concat("label", F.lit(" x"))).otherwise(F.col("label")).alias("label"), F.lit(" ").alias("description"), F.when(n % 3 == 0, "other").alias("merge_into"))
    sheet = sheet.unionByName(items.where("n % 5 = 0").select(F.concat(F.lit("no:"), "key").alias("key"), "label", F.lit("").alias("description"), F.lit("x").alias("merge_into")))
    return E.import_review(own, sheet)[1]


@query("SELECT l_suppkey AS s, format('0x{:x}', list_reduce(list_prepend(CAST(1 AS HUGEINT), list(CAST(l_partkey + 2 AS HUGEINT))), lambda a, b: (a * b) % 1000000007)) AS product FROM lineitem GROUP BY 1")
def modular_products(spark, sf_dir):
    item = Tables(spark, sf_dir)["lineitem"].select(F.col("l_suppkey").alias("s"), F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_partkey") + 2))).alias("c"))
    return C.modular_product(item, "s", "c", 1_000_000_007)
