"""Registry tables derived from the star schema, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: (tables it reads, SQL). Later ones may read earlier ones.
STANDINS: dict[str, tuple[list[str], str]] = {
    "approvals": (["orders"], "SELECT 'orders' AS tbl, CAST(o_orderkey AS STRING) AS row_id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "rows_": (["orders"], "SELECT CAST(o_orderkey AS STRING) AS _row_id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders"),
    "usage": (["events"], "SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'qr' ELSE concat('site', CAST(user_id % 4 AS STRING)) END AS surface, CASE WHEN value < 2 THEN '' ELSE regexp_replace(props, '[^0-9]', '', 'g') END AS view, CASE event_type WHEN 'error' THEN 'qr:scan' WHEN 'click' THEN 'view' ELSE event_type END AS event, CASE WHEN user_id % 11 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS session, CASE WHEN user_id % 9 = 0 THEN '' ELSE concat('C', CAST(user_id % 9 AS STRING)) END AS country FROM events"),
    "entries": (["orders", "customer"], "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS season_id, CAST(o_orderkey AS STRING) AS object_row_id, CAST(o_custkey AS STRING) AS artist_uid, c_name AS artist_name, c_mktsegment AS studio, concat('Piece ', CAST(o_orderkey AS STRING)) AS title, CAST(o_orderkey % 5 + 1 AS INT) AS edition_size, o_orderdate AS created_at, o_orderkey % 3 = 0 AS solo, o_orderkey % 97 = 0 AS legendary, o_totalprice > 100000 AS fingerprinted, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS height_mm FROM orders JOIN customer ON o_custkey = c_custkey"),
    "votes": (["lineitem", "orders"], "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(o_orderdate) AS INT) AS season_id, l_orderkey AS entry_id, CAST(l_suppkey AS STRING) AS voter_uid, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'"),
    "claims": (["lineitem", "orders"], "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(o_orderdate) AS INT) AS season_id, l_orderkey AS entry_id, CAST(l_orderkey AS STRING) AS object_row_id, CAST(l_suppkey AS STRING) AS collector_uid, concat('Collector ', CAST(l_suppkey AS STRING)) AS collector_name, CASE l_returnflag WHEN 'R' THEN 'verified' ELSE 'pending' END AS status, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'N')"),
    "categories": (["orders"], "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season_id, c.id AS category_id, CASE c.id WHEN 2 THEN 'measured' ELSE 'vote' END AS kind, c.id = 1 AS solo_only FROM orders, (SELECT 0 AS id UNION ALL SELECT 1 UNION ALL SELECT 2) c"),
    "award_votes": (["lineitem", "orders"], "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(year(o_orderdate) AS INT) AS season_id, CAST(l_linenumber % 3 AS INT) AS category_id, l_orderkey AS entry_id, CAST(l_suppkey AS STRING) AS voter_uid, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "nodes": (["supplier", "nation", "region", "customer"], "SELECT concat('supplier:', CAST(s_suppkey AS STRING)) AS id, s_name AS label, 'supplier' AS type FROM supplier UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), c_name, 'customer' FROM customer UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), n_name, 'nation' FROM nation UNION ALL SELECT concat('region:', CAST(r_regionkey AS STRING)), r_name, 'region' FROM region"),
    "edges": (["supplier", "nation", "region", "customer"], "SELECT concat('supplier:', CAST(s_suppkey AS STRING)) AS src, concat('nation:', CAST(s_nationkey AS STRING)) AS dst, 'based_at' AS type FROM supplier UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), concat('nation:', CAST(c_nationkey AS STRING)), 'based_at' FROM customer UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), concat('region:', CAST(n_regionkey AS STRING)), 'part_of' FROM nation"),
    "items": (["supplier", "customer", "part"], "SELECT concat('reg:studio:', CAST(s_suppkey AS STRING)) AS key, 'studio' AS kind, s_name AS label, CAST(s_nationkey AS STRING) AS city, CAST(s_suppkey AS BIGINT) AS n FROM supplier UNION ALL SELECT concat('reg:person:', CAST(c_custkey AS STRING)), 'person', concat('Person ', CAST(c_custkey % 700 AS STRING)), CAST(c_nationkey AS STRING), CAST(c_custkey AS BIGINT) FROM customer UNION ALL SELECT concat('reg:type:', CAST(p_partkey AS STRING)), 'type', p_type, '', CAST(p_partkey AS BIGINT) FROM part"),
    "seasons": (["orders"], "SELECT CAST(year(o_orderdate) AS INT) AS season_id, CASE WHEN max(year(o_orderdate)) >= 1998 THEN 'open' ELSE 'closed' END AS status, min(o_orderdate) AS starts, count(*) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS INT)"),
    "people": (["customer", "nation"], "SELECT CAST(c_custkey AS STRING) AS id, concat('Maker ', CAST(c_custkey % 400 AS STRING), ' ', n_name) AS name, concat(' ', c_mktsegment, ', ', n_name, '|', c_mktsegment) AS techniques, concat('supplier#', lpad(CAST(c_custkey % 97 AS STRING), 9, '0')) AS studio, CASE WHEN c_custkey % 5 = 0 THEN concat('MAKER ', CAST((c_custkey + 25) % 400 AS STRING), '  ', n_name) END AS mentor, concat('Learnt from maker ', CAST(c_custkey % 31 AS STRING), ' nation_', CAST(c_custkey % 7 AS STRING), ' at Supplier#00000000', CAST(c_custkey % 10 AS STRING), '.') AS bio FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "pieces": (["part"], "SELECT CAST(p_partkey AS STRING) AS id, p_name AS title, concat('maker ', CAST(p_partkey % 500 AS STRING), ' NATION_', CAST(p_partkey % 25 AS STRING)) AS maker, p_type AS techniques FROM part"),
    "studios_": (["supplier"], "SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name FROM supplier"),
    "found_by": (["lineitem"], "SELECT DISTINCT CAST(l_partkey AS STRING) AS object_id, CAST(l_suppkey AS STRING) AS collector_uid, concat('Collector ', CAST(l_suppkey AS STRING)) AS collector_name, CASE l_returnflag WHEN 'R' THEN 'verified' WHEN 'A' THEN 'pending' ELSE 'approved' END AS status FROM lineitem WHERE l_linenumber = 1"),
}


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the Parquet tables."""
    reads, sql = STANDINS[name]
    sql = sql.replace(", 'g')", ")")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in reads}
    for t in reads:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    return spark.sql(sql, **frames)


def with_standins(sql: str) -> str:
    """DuckDB SQL with the stand-ins that it names as common tables."""
    import re

    used = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{n} AS ({STANDINS[n][1]})" for n in used)
    if sql.strip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.strip()[15:]}"
    return f"WITH {ctes}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {ctes} {sql}"
