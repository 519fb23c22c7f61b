"""Queries on whole comparisons of fingerprints that are made from vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import comparison as C
from tessera.plans.base import Tables, query

#: Frames are the vectors of one label and run of 100 ids; even ones the capture, odd ones the registered object.
_FRAMES = """f AS (SELECT label * 100 + vec_id // 100 AS owner, vec_id % 2 AS half, vec_id AS seq, CASE WHEN vec_id % 11 > 0 THEN CAST(vec_id % 7 AS VARCHAR) END AS cell,
  CASE WHEN vec_id % 5 > 0 THEN embedding END AS emb, CASE WHEN label % 3 = 0 THEN embedding[1:20] END AS emb_p, CASE WHEN vec_id % 4 > 0 THEN embedding[21:40] END AS chist, CASE WHEN label = 2 AND vec_id % 3 = 0 THEN embedding[41:60] END AS chist_p,
  vec_id * 2654435761 % 4294967296 AS hi, vec_id % 17 * 40503 % 65536 AS lo, CASE WHEN vec_id % 13 > 0 THEN vec_id % 40 END AS sharp FROM embeddings WHERE len(embedding) > 0),
o AS (SELECT owner, half, count(*) AS shots, count(*) FILTER (WHERE coalesce(sharp, 12) >= 12) AS effort, owner % 100 AS n, CASE WHEN owner % 3 > 0 THEN 50 + owner % 100 * 10 END AS width, CASE WHEN owner % 4 > 0 THEN 100 + owner % 7 * 12 END AS height, 60 + owner % 9 * 4 AS rating FROM f GROUP BY owner, half)"""
_SCORES = f"""{_FRAMES}, v AS (SELECT owner, half, seq, coalesce(cell, 'c' || 'frames/' || lpad(CAST(row_number() OVER (PARTITION BY owner, half ORDER BY seq) - 1 AS VARCHAR), 3, '0') || '.jpg') AS cell, d.name AS descriptor, d.place, d.v AS v, hi, lo
  FROM f, LATERAL (SELECT unnest([{{'name': 'dino_p', 'place': 1, 'v': emb_p}}, {{'name': 'dino', 'place': 2, 'v': emb}}, {{'name': 'color_p', 'place': 3, 'v': chist_p}}, {{'name': 'color', 'place': 4, 'v': chist}}, {{'name': 'dhash', 'place': 5, 'v': [hi, lo]}}]) AS d) WHERE d.v IS NOT NULL),
w AS (SELECT *, CASE WHEN descriptor LIKE 'color%' THEN list_transform(v, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(v, lambda y: CAST(y AS DOUBLE)))) ELSE list_transform(v, lambda x: CAST(x AS DOUBLE)) END AS c FROM v),
s AS (SELECT q.owner AS q, r.owner AS r, q.descriptor, q.place, q.seq AS shot, r.seq AS view, r.cell, CASE WHEN q.descriptor = 'dhash' THEN greatest(0, least(1, (22 - bit_count(xor(q.hi, r.hi)) - bit_count(xor(q.lo, r.lo))) / 16)) ELSE greatest(0, least(1, list_inner_product(q.c, r.c) / (sqrt(list_inner_product(q.c, q.c)) * sqrt(list_inner_product(r.c, r.c))))) END AS sim
  FROM w q JOIN w r ON q.half = 0 AND r.half = 1 AND q.descriptor = r.descriptor AND q.owner <> r.owner),
best AS (SELECT q, r, descriptor, place, cell, round(sim, 4) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY q, r, descriptor, shot ORDER BY sim DESC, view) = 1),
g AS (SELECT q, r, descriptor, place, count(*) AS have, list_sort(list(sim) FILTER (WHERE sim >= 0.5), 'DESC') AS sims, count(DISTINCT cell) FILTER (WHERE sim >= 0.5) AS cells FROM best GROUP BY ALL),
n AS (SELECT owner, descriptor, half, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT g.*, n.n AS other, CAST(floor(100 * coalesce(list_sum(sims[1:8]) / least(len(sims), 8), 0) * (0.4 + 0.6 * least(1.0, cells / 6)) + 0.5) AS INT) AS confidence, coalesce(len(sims), 0) AS strong FROM g JOIN n ON n.owner = g.r AND n.descriptor = g.descriptor AND n.half = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY CASE WHEN have >= 3 AND other >= 3 AND descriptor <> 'dhash' THEN place WHEN descriptor = 'dino' THEN 6 WHEN descriptor = 'color' THEN 7 WHEN descriptor = 'color_p' THEN 8 WHEN descriptor = 'dhash' THEN 9 ELSE 10 END) AS k FROM b),
a AS (SELECT q, r, list(descriptor) AS all_, list('also:' || descriptor || ':' || confidence ORDER BY place) FILTER (WHERE k > 1) AS others FROM h GROUP BY q, r),
z AS (SELECT q.owner AS q, r.owner AS r, q.shots, q.effort, r.rating, q.width IS NULL AND q.height IS NULL AS no_q, r.width IS NULL AND r.height IS NULL AS no_r, round(greatest(abs(q.width - r.width) / greatest(q.width, r.width), abs(q.height - r.height) / greatest(q.height, r.height)), 3) AS apart FROM o q JOIN o r ON q.half = 0 AND r.half = 1),
m AS (SELECT h.*, a.all_, a.others, z.* EXCLUDE (q, r), CASE WHEN confidence >= 70 AND cells >= 3 THEN 'match' WHEN effort >= 8 AND confidence < 40 AND cells < 2 THEN 'nomatch' ELSE 'inconc' END AS said, coalesce(apart > 0.25, false) AS conflict FROM h JOIN a USING (q, r) JOIN z USING (q, r) WHERE k = 1)"""
_COMPARED = f"""WITH {_SCORES} SELECT q, r, descriptor, confidence, CASE WHEN conflict AND said = 'match' THEN 'inconc' ELSE said END AS verdict, CAST(cells AS INT) AS views_matched, CAST(strong AS INT) AS strong, apart <= 0.25 AS size_ok,
  concat_ws('|', 'headline:' || descriptor, CASE WHEN have < shots THEN 'partly_carried' END, array_to_string(others, '|'), CASE WHEN NOT list_contains(all_, 'dino') AND NOT list_contains(all_, 'dino_p') THEN 'no_texture' END,
    'size:' || CASE WHEN no_q AND no_r THEN 'none' WHEN no_q THEN 'not_captured' WHEN no_r THEN 'not_registered' WHEN apart IS NULL THEN 'not_comparable' WHEN apart <= 0.25 THEN 'within' ELSE 'apart' END) AS reasons,
  concat_ws('|', CASE WHEN conflict AND said = 'match' THEN 'held_by_size' END, CASE WHEN rating < 75 THEN 'thin_reference' END, CASE WHEN effort < 8 THEN 'few_sharp_shots' END, CASE WHEN descriptor IN ('color', 'color_p') THEN 'colour_alone' END) AS caveats FROM m"""


def _objects(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = Tables(spark, sf_dir)["embeddings"].where(F.size("embedding") > 0).withColumn("e", F.col("embedding").cast("array<double>"))
    n, id_ = F.col("vec_id"), (F.col("label") * 100 + F.floor(F.col("vec_id") / 100)).cast("long")
    some = lambda c, x: F.when(c, x)
    pose = F.struct(F.lit(None).cast("double").alias("az"), F.lit(None).cast("double").alias("el"))
    frame = F.struct(
        F.lit(None).cast("string").alias("file"), some(n % 11 > 0, (n % 7).cast("string")).alias("cell"), F.lit(None).cast("int").alias("sector"), n.cast("int").alias("seq"), some(n % 4 > 0, F.slice("e", 21, 20)).alias("chist"),
        some((F.col("label") == 2) & (n % 3 == 0), F.slice("e", 41, 20)).alias("chist_p"), F.array(n * 2654435761 % 4294967296, n % 17 * 40503 % 65536).alias("dhash"), some(n % 5 > 0, F.col("e")).alias("emb"), some(F.col("label") % 3 == 0, F.slice("e", 1, 20)).alias("emb_p"),
        pose.alias("mat"), some(n % 13 > 0, (n % 40).cast("double")).alias("sharp"),
    )
    own = v.select(id_.alias("id"), (n % 2).alias("half"), n.alias("n"), frame.alias("f")).groupBy("id", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "f"))), lambda x: x["f"]).alias("frames"))
    size = F.struct(F.when(F.col("id") % 3 > 0, 50.0 + F.col("id") % 100 * 10).alias("width"), F.lit(None).cast("double").alias("depth"), F.when(F.col("id") % 4 > 0, 100.0 + F.col("id") % 7 * 12).alias("height"))
    meta = F.struct(F.lit(None).cast("struct<name: string, hex: string>").alias("dominantColor"), size.alias("dimensions_mm"), F.lit(None).cast("boolean").alias("hasEmbeddings"))
    fp = F.struct((60.0 + F.col("id") % 9 * 4).alias("rating"), F.lit("Strong").alias("tier"), F.lit(None).cast("string").alias("created"), meta.alias("metadata"), "frames")
    own = own.select("id", "half", fp.alias("fp"))
    return own.where("half = 0").drop("half"), own.where("half = 1").drop("half")


def _told(compared: DataFrame) -> DataFrame:
    return compared.select("q", "r", "descriptor", "confidence", "verdict", "views_matched", "strong", "size_ok", F.array_join("reasons", "|").alias("reasons"), F.array_join("caveats", "|").alias("caveats"))


@query(_COMPARED)
def compare_objects(spark, sf_dir):
    """Every capture with every registered object by the older rules: five descriptors, headline, size, coded reasons."""
    captures, refs = _objects(spark, sf_dir)
    return _told(C.compare(captures, refs, rules="v1"))


@query()
def compare_one_to_one(spark, sf_dir):
    """As compare_objects by the newer rules, over the ten objects with the nearest mean vectors."""
    captures, refs = _objects(spark, sf_dir)
    return _told(C.compare(captures, refs, C.near_pairs(captures, refs, 10)))


@query(f"WITH {_FRAMES} SELECT o.owner AS id, o.rating AS rating, 'Strong' AS tier, count(*) AS views, count(*) FILTER (WHERE emb IS NOT NULL OR emb_p IS NOT NULL) AS views_with_embeddings, count(*) FILTER (WHERE emb IS NOT NULL OR emb_p IS NOT NULL) > 0 AS has_embeddings, o.width AS width, o.height AS height FROM f JOIN o ON f.owner = o.owner AND f.half = o.half WHERE f.half = 1 GROUP BY ALL")
def fingerprint_summaries(spark, sf_dir):
    own = C.fingerprint_summary(_objects(spark, sf_dir)[1], "id", "fp")
    return own.select("id", F.col("rating").cast("int").alias("rating"), "tier", F.col("views").cast("long").alias("views"), F.col("views_with_embeddings").cast("long").alias("views_with_embeddings"), "has_embeddings", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
