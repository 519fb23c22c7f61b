"""Queries on what lands from outside: archives of sessions, their index, corpora of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.base import Tables, query
from tessera.shared import shared_dir
from tessera.sources import sessions as S

_MANIFEST = "json_object('kind', CASE page_id % 3 WHEN 0 THEN 'verify' WHEN 1 THEN 'ENROLL' ELSE 'other' END, 'object', json_object('id', page_id, 'title', url), 'candidates', json_object('items', json_array(json_object('title', 'near ' || page_id, 'confidence', page_id % 100))))"


def _uploads(spark, sf_dir: str) -> DataFrame:
    """An archive for each page: its text behind the first bytes of a picture, and a manifest; some broken in several ways."""

    def run(batches):
        import io
        import json
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                kind = ("verify", "ENROLL", "other")[i % 3]
                manifest = json.dumps({"kind": kind, "object": {"id": i, "title": url}, "candidates": {"items": [{"title": f"near {i}", "confidence": i % 100}]}})
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("images/0.jpg", b"\xff\xd8\xff" + (html or "").encode())
                    z.writestr("notes.txt", "left out")
                    if i % 7 != 0:
                        z.writestr("session/manifest.json", manifest if i % 7 != 2 else manifest[:-1])
                data = file.getvalue()
                out.append(manifest.encode() if i % 7 == 3 else data[: len(data) // 2] if i % 7 == 1 else data)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return Tables(spark, sf_dir)["pages"].select("page_id", "url", "html").mapInArrow(run, "path string, content binary")


@query("SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'no_manifest' WHEN 1 THEN 'bad_zip' WHEN 2 THEN 'bad_manifest' END AS error, CASE WHEN page_id % 7 > 3 THEN 1 ELSE 0 END AS images, CASE WHEN page_id % 7 > 3 THEN 3 + octet_length(encode(coalesce(html, ''))) END AS bytes FROM pages")
def session_archives(spark, sf_dir):
    """Archives read back: pictures and their sizes, or the code of what is wrong."""
    files = S.unpack_uploads(_uploads(spark, sf_dir)).groupBy("path")
    return files.agg(F.max("error").alias("error"), F.count_if(F.col("role") == "image").alias("images"), F.sum("size").alias("bytes")).select(F.col("path").cast("long").alias("page_id"), "error", "images", "bytes")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'verify' ELSE 'enroll' END AS kind, page_id AS object_id, coalesce(url[:200], '') AS object_title, 'undecided' AS decision, page_id % 100 AS top_score, 'near ' || page_id AS top_candidate, 1 AS n_candidates, page_id % 100 AS confidence FROM pages WHERE page_id % 7 > 2")
def session_index(spark, sf_dir):
    """The index columns of the archives that are sound."""
    sound = S.unpack_uploads(_uploads(spark, sf_dir)).where("role = 'session' AND error IS NULL")
    out = S.session_index(sound, "path", "manifest")
    return out.select(F.col("path").cast("long").alias("page_id"), "kind", "object_id", "object_title", "decision", "top_score", "top_candidate", "n_candidates", "confidence")


_CORPUS = "c AS (SELECT vec_id, label * 1000 + vec_id % 50 AS oid, vec_id % 13 AS odd, embedding FROM embeddings), g AS (SELECT * FROM c WHERE odd > 4)"


def _landed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """embeddings written as one sorted run of JSON lines, some broken, and read again."""
    v = Tables(spark, sf_dir)["embeddings"].withColumns({"oid": F.col("label") * 1000 + F.col("vec_id") % 50, "odd": F.col("vec_id") % 13})
    whole = F.to_json(F.struct(F.col("oid").cast("string").alias("object_id"), F.concat(F.lit("v"), "vec_id").alias("title"), F.col("embedding").alias("embedding_centroid"), F.array(F.lit("a"), F.lit("")).alias("techniques")))
    line = F.when(F.col("odd") == 0, F.left(whole, F.lit(30))).when(F.col("odd") == 1, "[1, 2]").when(F.col("odd") == 2, F.to_json(F.struct(F.col("embedding").alias("embedding_centroid")))).when(F.col("odd") == 3, F.to_json(F.struct("oid"))).when(F.col("odd") == 4, F.concat(F.lit('{"object_id":"x","embedding_centroid":["'), "vec_id", F.lit('z"]}'))).otherwise(whole)
    import uuid

    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    v.select("vec_id", line.alias("value")).repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select("value").write.text(path)
    return S.read_corpus_jsonl(spark, path)


@query(f"WITH {_CORPUS} SELECT CAST(oid AS VARCHAR) AS object_id, 'v' || min(vec_id) AS title, 'a' AS techniques, any_value(len(embedding)) AS size FROM g GROUP BY oid")
def corpus_records(spark, sf_dir):
    """The first good record of each object, from files of JSON lines."""
    return _landed(spark, sf_dir)[0].select("object_id", "title", F.array_join("techniques", "|").alias("techniques"), F.size("embedding_centroid").cast("long").alias("size"))


@query(f"WITH {_CORPUS} SELECT CASE odd WHEN 0 THEN 'broken' WHEN 1 THEN 'no_object' WHEN 4 THEN 'no_vector' ELSE 'no_id' END AS reason, count(*) AS n FROM c WHERE odd <= 4 GROUP BY 1 UNION ALL SELECT 'repeated', (SELECT count(*) - count(DISTINCT oid) FROM g)")
def corpus_left_out(spark, sf_dir):
    """What was left out of them, by reason."""
    return _landed(spark, sf_dir)[1]


#: Types of parts are the techniques; every second brand is a trait, whose facet is its first letters.
_REPLIES = """p AS (SELECT p_partkey AS id, p_type, p_brand, p_size % 12 / 10.0 AS c, p_partkey % 5 AS how FROM part),
brands AS (SELECT DISTINCT p_brand FROM part WHERE CAST(right(p_brand, 1) AS INT) % 2 = 0)"""


def _replies(spark, sf_dir: str):
    p = Tables(spark, sf_dir)["part"]
    how, q = F.col("p_partkey") % 5, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    score = F.round(F.col("p_size") % 12 / 10.0, 1).cast("string")
    listed = F.concat(F.lit('Here {it} is: ```json {"techniques": [{"label": '), q(F.upper("p_type")), F.lit(', "confidence": '), score, F.lit('}, "Odd words"], "traits": {"any": ['), q(F.col("p_brand")), F.lit(']}, "caveats": ["a", null, "b"]} ```'))
    mapped = F.concat(F.lit('{"techniques": {'), q(F.col("p_type")), F.lit(': "'), score, F.lit('"}, "traits": ['), q(F.lower("p_brand")), F.lit(', '), q(F.lower("p_brand")), F.lit("]}"))
    single = F.concat(F.lit('{"techniques": '), q(F.concat(F.lit("  "), F.col("p_type"))), F.lit(', "evidence": "seen"}'))
    reply = F.when(how == 0, listed).when(how == 1, mapped).when(how == 2, single).when(how == 3, F.substring(listed, 1, 60)).otherwise(F.lit(None))
    techniques = p.select("p_type").distinct().select(F.col("p_type").alias("term"), F.col("p_type").alias("label"))
    traits = p.select("p_brand").distinct().where("CAST(right(p_brand, 1) AS INT) % 2 = 0").select(F.col("p_brand").alias("term"), F.col("p_brand").alias("label"), F.left("p_brand", F.lit(2)).alias("facet"))
    from tessera.operators.replies import normalise_replies

    return normalise_replies(p.select(F.col("p_partkey").alias("id"), reply.alias("reply")), "id", "reply", techniques, traits)


@query(f"""WITH {_REPLIES} SELECT id, CASE WHEN how < 2 THEN p_type || ':' || printf('%.2f', least(1, c)) WHEN how = 2 THEN p_type || ':0.50' ELSE '' END AS techniques, CASE WHEN how < 2 AND b.p_brand IS NOT NULL THEN left(p.p_brand, 2) || '=' || p.p_brand || ':0.50' ELSE '' END AS traits,
 CASE WHEN how = 0 THEN concat_ws('|', 'Odd words', CASE WHEN b.p_brand IS NULL THEN p.p_brand END) WHEN how = 1 AND b.p_brand IS NULL THEN lower(p.p_brand) ELSE '' END AS unmapped, CASE WHEN how = 0 THEN 'a; b' ELSE '' END AS caveats, CASE WHEN how = 2 THEN 'seen' ELSE '' END AS evidence FROM p LEFT JOIN brands b ON b.p_brand = p.p_brand""")
def model_replies(spark, sf_dir):
    """Replies in several forms, one of them cut off, against vocabularies of types and brands."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["label"], F.lit(":"), F.format_string("%.2f", x["confidence"]))), "|")
    traits = F.array_join(F.transform(F.map_entries("traits"), lambda e: F.concat(e["key"], F.lit("="), told(e["value"]))), "|")
    return _replies(spark, sf_dir).select("id", told(F.col("techniques")).alias("techniques"), traits.alias("traits"), F.array_join("unmapped", "|").alias("unmapped"), "caveats", F.array_join("evidence", "|").alias("evidence"))


_CELLS = "c AS (SELECT p_partkey AS id, p_type || '; ' || p_brand || ' | x ' || lower(p_type) || ' y (a, b)' AS cell, p_type, p_brand FROM part)"


def _resolved(spark, sf_dir: str) -> DataFrame:
    from tessera.operators.terms import resolve_terms, vocabulary

    p = Tables(spark, sf_dir)["part"]
    cell = F.concat("p_type", F.lit("; "), "p_brand", F.lit(" | x "), F.lower("p_type"), F.lit(" y (a, b)"))
    none = F.lit(None).cast("array<string>")
    terms = p.select("p_type").distinct().select(F.concat(F.lit("t:"), "p_type").alias("id"), F.col("p_type").alias("label"), none.alias("alternatives"), none.alias("old"))
    return resolve_terms(p.select(F.col("p_partkey").alias("id"), cell.alias("cell")), "id", "cell", vocabulary(terms))


@query(f"WITH {_CELLS} SELECT id, 0 AS n, p_type AS part, 't:' || p_type AS term_id, 'label' AS how FROM c UNION ALL SELECT id, 1, p_brand, NULL, NULL FROM c UNION ALL SELECT id, 2, 'x ' || lower(p_type) || ' y (a, b)', 't:' || p_type, 'contained' FROM c")
def resolved_terms(spark, sf_dir):
    """Parts of cells as terms: whole, unknown, and found inside."""
    return _resolved(spark, sf_dir)


@query("SELECT p_brand AS part, count(*) AS n FROM part GROUP BY 1")
def unknown_terms(spark, sf_dir):
    from tessera.operators.terms import unknown_terms as unknown

    return unknown(_resolved(spark, sf_dir))
