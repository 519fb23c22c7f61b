"""Queries on records: facts, documents, identities, measurements taken anew, frames in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tables as table_functions
from tessera.operators import records as R
from tessera.operators import staging as S
from tessera.plans.base import Tables, query
from tessera.plans.staging import _CLAIMS, _DUCK, _ITEMS, _NORM, _SLUG, _staged, _tables, _vocab
from tessera.shared import cut

_CTES = f"{_ITEMS[5:].rsplit('SELECT * FROM it', 1)[0].rstrip()}, {_CLAIMS[5:].split(', c AS (', 1)[1].rsplit(')', 1)[0].join(('cl AS (', ')'))}"
_FACTS = f"""WITH {_CTES}, f AS (SELECT DISTINCT * FROM cl WHERE prop NOT IN ('content hash', 'image URL', 'described at URL'))
SELECT f.key, prop, CASE WHEN value LIKE 'reg:%' AND prop <> 'content hash' THEN coalesce(i.label, value) WHEN prop IN ('width', 'depth', 'height') THEN value || ' ' || extra ELSE value END AS value, CASE WHEN value LIKE 'reg:%' THEN value END AS item,
 CASE WHEN quals = '' THEN '' ELSE replace(quals, '=', ': ') END AS qualifiers FROM f LEFT JOIN it i ON i.key = f.value"""


@query(_FACTS)
def record_facts(spark, sf_dir):
    """Facts of all staged items, items and qualifiers by their labels."""
    s = _staged(spark, sf_dir)
    return R.facts(s.claims, s.items, most=1000).select("key", "prop", "value", "item", F.array_join("qualifiers", "|").alias("qualifiers"))


@query(
    f"""WITH {_ITEMS[5:].rsplit("SELECT * FROM it", 1)[0]}, pc AS (SELECT {_NORM.format("maker")} AS n, count(*) AS n_pieces, max(year) AS y FROM ob GROUP BY 1),
 cc AS (SELECT object_row_id AS r, count(*) AS collected FROM claims WHERE status = 'verified' GROUP BY 1), rows AS (SELECT 'reg:artists:' || _row_id AS key, 3 + CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN remark IS NULL THEN 0 ELSE 1 END AS n_fields, CASE WHEN website IS NOT NULL THEN website END AS web FROM ar
  UNION ALL SELECT 'reg:studios:' || _row_id, 3 + CASE WHEN type IS NULL THEN 0 ELSE 1 END, NULL FROM st)
SELECT it.key, it.kind, it.label, CASE WHEN it.kind = 'technique' THEN 'technique' ELSE it.description END AS description, rows.n_fields, rows.web AS website, CASE WHEN it.kind = 'person' THEN coalesce(n_pieces, 0) ELSE 0 END AS n_pieces
FROM it LEFT JOIN rows ON rows.key = it.key LEFT JOIN pc ON it.kind = 'person' AND pc.n = {_NORM.format("it.label")}"""
)
def record_documents(spark, sf_dir):
    """Documents of all items: fields of their rows, links, pieces of their makers."""
    s = _staged(spark, sf_dir)
    tables = {k: v for k, v in _tables(spark, sf_dir).items() if k in ("artists", "studios", "objects")}
    out = R.record_documents(s.items, s.claims, tables)
    told = F.col("key").startswith("reg:artists:") | F.col("key").startswith("reg:studios:")
    return out.select("key", "kind", "label", "description", F.when(told, F.size("fields")).alias("n_fields"), F.when(told, F.col("links")["website"]).alias("website"), "n_pieces")


@query(
    f"""WITH {_DUCK}, q AS (SELECT c_custkey AS id, 'Maker ' || CAST((c_custkey * 3) % 900 AS VARCHAR) || ' ' || n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
 row AS (SELECT {_NORM.format("artist_name")} AS n, min('reg:artists:' || _row_id) AS row_key, arg_min(artist_name, 'reg:artists:' || _row_id) AS row_name FROM ar GROUP BY 1), seen AS (SELECT DISTINCT {_NORM.format("maker")} AS n FROM ob)
SELECT q.id, coalesce(row_name, q.name) AS name, row_key AS key, seen.n IS NOT NULL AS seen FROM q LEFT JOIN row ON row.n = {_NORM.format("q.name")} LEFT JOIN seen ON seen.n = {_NORM.format("q.name")} WHERE row_key IS NOT NULL OR seen.n IS NOT NULL"""
)
def maker_identities(spark, sf_dir):
    """Who names are: directory rows, and names that the record has seen."""
    t = Tables(spark, sf_dir)
    name = F.concat(F.lit("Maker "), ((F.col("c_custkey") * 3) % 900).cast("string"), F.lit(" "), "n_name")
    asked = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.array(name).alias("names"), F.lit(False).alias("account"))
    tables = _tables(spark, sf_dir)
    directory = tables["artists"].select(F.concat(F.lit("reg:artists:"), "_row_id").alias("key"), F.col("artist_name").alias("name"))
    items = directory.where("false").select("key", F.lit("person").alias("kind"), F.col("name").alias("label"))
    return R.maker_identities(asked, directory, items, tables["objects"].select(F.col("maker").alias("name"))).select("id", "name", "key", "seen")


@query(
    "WITH m AS (SELECT p_brand, p_size AS old, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice / 100 END AS new, p_size * 1.1 AS truth FROM part) SELECT p_brand, 'size' AS measure, count(*) AS n, 0 AS gained, count(*) FILTER (WHERE new IS NULL) AS lost, count(*) FILTER (WHERE old <> new) AS changed, round(avg(abs(new - truth)), 6) AS mean_abs_error, round(avg(abs(old - truth)), 6) AS was_abs_error, count(*) FILTER (WHERE abs(new - truth) < abs(old - truth)) AS better FROM m GROUP BY 1"
)
def reprocess_report(spark, sf_dir):
    """Sizes measured anew in Arrow batches, against the old ones and the truth, by brand."""

    def measure(batch):
        return [{"size": price / 100} if key % 6 else {} for key, price in zip(*(batch.column(c).to_pylist() for c in ("p_partkey", "p_retailprice")), strict=True)]

    p = Tables(spark, sf_dir)["part"].select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("size"), (F.col("p_size") * F.lit(1.1)).alias("true_size"))
    out = R.reprocess_report(R.reprocess(p, ["size"], measure, ["p_partkey", "p_retailprice"]), ["size"], ["p_brand"])
    return out.select("p_brand", "measure", "n", "gained", "lost", "changed", F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round("was_abs_error", 6).alias("was_abs_error"), "better")


@query("SELECT vec_id // 10 AS id, CAST(vec_id % 10 + 1 AS INT) AS seq, CASE WHEN vec_id % 3 = 0 THEN 'c' || vec_id ELSE 'cframes/' || lpad(CAST(row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS VARCHAR), 3, '0') || '.jpg' END AS cell, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def frames_in_sql(spark, sf_dir):
    """The frames of fingerprints in JSON, by a table function in a lateral join."""
    table_functions.register(spark)
    v = Tables(spark, sf_dir)["embeddings"]
    frame = F.struct((F.col("vec_id") % 10 + 1).alias("seq"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("c"), "vec_id")).alias("cell"), F.col("embedding").alias("emb"))
    prints = v.groupBy(F.floor(F.col("vec_id") / 10).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", frame.alias("f")))), lambda x: x["f"]).alias("frames"))
    prints = prints.select("id", F.to_json(F.struct("frames")).alias("fp"))
    return spark.sql("SELECT id, seq, cell, round(aggregate(emb, 0D, (a, x) -> a + x), 4) AS total FROM {prints}, LATERAL frames(fp, 'emb') f", prints=prints)


@query("WITH p AS (SELECT c_custkey AS id, c_custkey % 300 AS g, CASE WHEN c_custkey % 5 = 0 THEN 'artists' ELSE 'objects' END AS tbl, CASE WHEN c_custkey % 11 = 0 THEN 'Q' || c_custkey ELSE '' END AS qid, 1 + c_custkey % 3 AS n FROM customer), k AS (SELECT *, 'k' || lpad(CAST(id AS VARCHAR), 9, '0') AS key FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY qid = '', CASE tbl WHEN 'artists' THEN 0 ELSE 7 END, -n, key) AS r, count(*) OVER (PARTITION BY g) AS m FROM k), f AS (SELECT g, min(key) FILTER (WHERE r = 1) AS best, max(n) AS claims, count(*) - 1 AS extra FROM o GROUP BY 1) SELECT o.key, CASE WHEN m > 1 AND r > 1 THEN 'duplicate' ELSE 'new' END AS status, CASE WHEN m > 1 AND r > 1 THEN best END AS canonical, CAST(CASE WHEN r = 1 THEN claims + extra ELSE n END AS BIGINT) AS n_claims FROM o JOIN f USING (g)")
def fold_clusters(spark, sf_dir):
    """Clusters of customers folded: published first, then by source, claims and key; canonical items gain claims and keys."""
    from tessera.operators import resolution as E

    c = Tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("id"))
    key = F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 9, "0"))
    none = F.array().cast("array<string>")
    items = c.select(key.alias("key"), F.lit("person").alias("kind"), F.lit("same").alias("label"), F.lit("").alias("description"), none.alias("aliases"), F.when(F.col("id") % 5 == 0, "artists").otherwise("objects").alias("tbl"), F.lit("new").alias("status"), F.when(F.col("id") % 11 == 0, F.concat(F.lit("Q"), "id")).otherwise("").alias("qid"), (F.col("id") % 300).cast("string").alias("cluster"))
    claims = c.select(key.alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 3)).alias("n")).select("key", F.col("n").cast("int").alias("n"), F.concat(F.lit("p"), "n").alias("prop"), F.lit("string").alias("kind"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("extra"), F.array().cast("array<struct<prop: string, kind: string, value: string, extra: string>>").alias("quals"))
    out, folded = E.fold_clusters(items, claims)
    return out.join(folded.groupBy("key").agg(F.count("*").alias("n_claims")), "key").select("key", "status", "canonical", "n_claims")


@query(f"WITH {_DUCK} SELECT 'reg:studios:' || _row_id AS key, name AS label, 'reg:place:' || {_SLUG.format("city")} || ' [' || city || ']' AS \"located in\", CASE WHEN lng <> '999' AND (lat <> '0' OR lng <> '0') THEN format('{{:.5f}},{{:.5f}}', CAST(lat AS DOUBLE), CAST(lng AS DOUBLE)) ELSE '' END AS coordinates, founded[7:] || '-00-00' AS inception FROM st")
def review_pivot(spark, sf_dir):
    """Studios with a column for each property, as reviewers get them."""
    s = S.stage({"studios": _tables(spark, sf_dir)["studios"]}, _vocab(spark))
    out = R.review_table(cut(s.items), cut(s.claims), props=["located in", "coordinates", "inception"])
    return out.where("startswith(key, 'reg:studios:')").drop("description")


@query("SELECT CAST(p_partkey AS VARCHAR) AS _row_id, p_name AS title FROM part WHERE contains(lower(p_name), 'blue') AND p_brand = 'Brand#4'")
def filter_pieces(spark, sf_dir):
    p = Tables(spark, sf_dir)["part"].select(F.col("p_partkey").cast("string").alias("_row_id"), F.upper("p_name").alias("title"), "p_name", F.concat(F.lit(" "), F.lower("p_brand")).alias("maker"))
    return R.filter_pieces(p, q=" Blue ", maker="BRAND#4").select("_row_id", F.col("p_name").alias("title"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS _row_id, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def board_listing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.rows_.select("_row_id", "o_orderpriority", F.lit("a@b.c").alias("contact_email"), F.col("o_totalprice").alias("_imported_at"))
    return R.board_listing(rows, "orders", t.approvals)
