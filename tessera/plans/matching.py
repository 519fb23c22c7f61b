"""Queries on vectors and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.plans.base import Tables, query

_U = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0)"
_S = f"{_U}, s AS (SELECT a.id AS query, b.id AS id, b.label, round(greatest(-1, least(1, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))), 6) AS similarity FROM u a JOIN u b ON a.id <> b.id AND len(a.v) = len(b.v)), near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INT) AS rank FROM s), knn AS (SELECT query, rank, id, similarity, label FROM near WHERE rank <= 5)"
_V = f"{_S}, voters AS (SELECT * FROM knn WHERE similarity > 0 AND label IS NOT NULL), label_vote AS (SELECT query, label, round(sum(similarity) / any_value(total), 4) AS score, count(*) AS support FROM voters JOIN (SELECT query, sum(similarity) AS total FROM voters GROUP BY 1) USING (query) GROUP BY query, label)"


def _vectors(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir)["embeddings"].select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"WITH {_S} SELECT query, rank, id, similarity FROM knn")
def vector_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return M.knn(v, v, "id", "embedding")


@query(f"WITH {_V} SELECT * FROM label_vote")
def label_votes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return M.vote_labels(M.knn(v, v, "id", "embedding"), v.select("id", "label"))


_PRF = f"{_V}, p AS (SELECT query AS id, label FROM label_vote WHERE score >= 0.5), c AS (SELECT coalesce(t.label, p.label) AS label, count(*) FILTER (WHERE t.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.id IS NULL) AS fp, count(*) FILTER (WHERE p.id IS NULL) AS fn, count(t.id) AS support FROM u t FULL JOIN p ON t.id = p.id AND t.label = p.label GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM c)"


@query(f"WITH {_PRF} SELECT label, tp, fp, fn, support, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 4) AS f1 FROM r")
def evaluate_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return M.evaluate_knn(v, "id", "embedding", v.select("id", "label"))


@query(f"WITH {_U} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) AS similarity FROM u a JOIN u b ON a.id < b.id AND len(a.v) = len(b.v) WHERE round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) >= 0.4")
def similar_pairs(spark, sf_dir):
    return M.similar_pairs(_vectors(spark, sf_dir), "id", "embedding", 0.4)


@query("WITH x AS (SELECT vec_id // 10 AS owner, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT owner, pos, avg(CAST(e AS DOUBLE)) AS m FROM x GROUP BY 1, 2), n AS (SELECT owner, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1) SELECT owner, CAST(pos AS INT) AS pos, round(m / norm, 9) AS x FROM m JOIN n USING (owner) WHERE norm > 0")
def object_centroids(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("owner", F.floor(F.col("id") / 10))
    own = M.centroids(v, "owner", "embedding")
    return own.select("owner", F.posexplode("centroid").alias("at", "x")).select("owner", (F.col("at") + 1).alias("pos"), F.round("x", 9).alias("x"))


@query("WITH x AS (SELECT vec_id // 10 AS owner, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT owner, pos, avg(CAST(e AS DOUBLE)) AS m FROM x GROUP BY 1, 2), r AS (SELECT owner, CAST(pos - 1 AS INT) AS dominant, row_number() OVER (PARTITION BY owner ORDER BY m DESC, pos) AS k FROM m) SELECT owner, dominant FROM r WHERE k = 1")
def dominant_bins(spark, sf_dir):
    return M.mean_histogram(_vectors(spark, sf_dir).withColumn("owner", F.floor(F.col("id") / 10)), "owner", "embedding")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def label_histogram(spark, sf_dir):
    return M.label_histogram(_vectors(spark, sf_dir).select("label"))


#: Views of one object are the vectors with one label and the same number of fives; every second view is the capture.
_VIEWS = "o AS (SELECT label * 100 + vec_id // 100 AS owner, vec_id AS seq, vec_id % 7 AS cell, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(embedding)) AS d, vec_id % 2 AS half FROM embeddings WHERE len(embedding) > 0)"
_SEEN = f"{_VIEWS}, seen AS (SELECT q.owner AS q, r.owner AS r, q.seq AS shot, r.seq AS view, r.cell, greatest(0, list_inner_product(q.d, r.d) / (sqrt(list_inner_product(q.d, q.d)) * sqrt(list_inner_product(r.d, r.d)))) AS sim FROM o q JOIN o r ON q.owner <> r.owner AND q.half = 0 AND r.half = 1), best AS (SELECT q, r, shot, view, cell, round(sim, 4) AS sim FROM seen QUALIFY row_number() OVER (PARTITION BY q, r, shot ORDER BY sim DESC, view) = 1)"
_AGG = f"{_SEEN}, strong AS (SELECT q, r, list_sort(list(sim) FILTER (WHERE sim >= 0.5), 'DESC') AS s, count(DISTINCT cell) FILTER (WHERE sim >= 0.5) AS views_matched FROM best GROUP BY 1, 2), agg AS (SELECT q, r, views_matched, coalesce(len(s), 0) AS strong, CASE WHEN len(s) > 0 THEN list_sum(s[1:8]) / least(len(s), 8) ELSE 0 END AS quality, least(1.0, views_matched / 6) AS spread FROM strong), v1 AS (SELECT q, r, CAST(floor(100 * quality * (0.4 + 0.6 * spread) + 0.5) AS INT) AS confidence, round(quality, 4) AS quality, round(spread, 4) AS spread, views_matched, CAST(strong AS INT) AS strong FROM agg)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir).where(F.size("embedding") > 0)
    own = v.select((F.col("label") * 100 + F.floor(F.col("id") / 100)).cast("long").alias("owner"), F.col("id").alias("seq"), (F.col("id") % 7).alias("cell"), F.col("embedding").cast("array<double>").alias("descriptor"))
    return own.where("seq % 2 = 0"), own.where("seq % 2 = 1")


def _matched(spark, sf_dir) -> DataFrame:
    return M.match_all(*_sides(spark, sf_dir))


@query(f"WITH {_SEEN} SELECT * FROM best")
def match_frames(spark, sf_dir):
    return M.best_views(*_sides(spark, sf_dir)).drop("has", "assigned")


@query(f"WITH {_AGG} SELECT * FROM v1")
def aggregate_match(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"WITH {_AGG}, b AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank, lead(confidence) OVER w AS nxt FROM v1 WINDOW w AS (PARTITION BY q ORDER BY confidence DESC, views_matched DESC, r)) SELECT q, rank, r, confidence, CASE WHEN rank = 1 THEN confidence - nxt END AS margin, coalesce(rank = 1 AND confidence - nxt < 10 AND nxt >= 40, false) AS ambiguous FROM b WHERE rank <= 5")
def match_candidates(spark, sf_dir):
    return M.candidates(_matched(spark, sf_dir))


@query(f"WITH {_AGG} SELECT q, r, CASE WHEN confidence >= 70 AND views_matched >= 3 THEN 'match' WHEN confidence < 40 AND views_matched < 2 THEN 'nomatch' ELSE 'inconc' END AS verdict FROM v1")
def match_verdicts(spark, sf_dir):
    return _matched(spark, sf_dir).select("q", "r", M.verdict(F.col("confidence"), F.col("views_matched"), F.lit(8)).alias("verdict"))


@query()
def assign_frames(spark, sf_dir):
    return M.match_all(*_sides(spark, sf_dir), "v2")


@query(f"WITH {_AGG}, c AS (SELECT range AS cut FROM range(101)), n AS (SELECT CAST(cut AS INT) AS cut, count(*) FILTER (WHERE confidence >= cut AND q // 100 = r // 100) AS tp, count(*) FILTER (WHERE confidence >= cut AND q // 100 <> r // 100) AS fp, count(*) FILTER (WHERE confidence < cut AND q // 100 = r // 100) AS fn, count(*) FILTER (WHERE confidence < cut AND q // 100 <> r // 100) AS tn FROM v1, c GROUP BY 1) SELECT cut, tp, fp, fn, tn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS youden FROM n")
def match_bench(spark, sf_dir):
    scored = _matched(spark, sf_dir).select(F.col("confidence").alias("score"), (F.floor(F.col("q") / 100) == F.floor(F.col("r") / 100)).alias("same"))
    return M.match_bench(scored)


@query(f"WITH {_AGG}, v AS (SELECT *, q // 100 = r // 100 AS same, CASE WHEN confidence >= 70 AND views_matched >= 3 THEN 'match' WHEN confidence < 40 AND views_matched < 2 THEN 'nomatch' ELSE 'inconc' END AS verdict FROM v1) SELECT count(*) FILTER (WHERE same) AS positives, count(*) FILTER (WHERE NOT same) AS negatives, count(*) FILTER (WHERE same AND verdict = 'match') AS true_accepts, count(*) FILTER (WHERE NOT same AND verdict = 'match') AS false_accepts, count(*) FILTER (WHERE NOT same AND verdict = 'nomatch') AS true_rejects, min(confidence) FILTER (WHERE same) - max(confidence) FILTER (WHERE NOT same) AS separation, round(avg(confidence) FILTER (WHERE NOT same), 1) AS other_mean, median(confidence) FILTER (WHERE same) AS same_median, count(DISTINCT (least(q // 100, r // 100), greatest(q // 100, r // 100))) FILTER (WHERE NOT same) AS piece_pairs FROM v")
def bench_report(spark, sf_dir):
    """How verdicts did over all pairs of captures and objects."""
    label = lambda c: F.floor(F.col(c) / 100).alias(f"{c}_label")
    pairs = _matched(spark, sf_dir).select("q", "r", label("q"), label("r"), "confidence", M.verdict(F.col("confidence"), F.col("views_matched"), F.lit(8)).alias("verdict"))
    return M.bench_report(pairs).select("positives", "negatives", "true_accepts", "false_accepts", "true_rejects", "separation", "other_mean", "same_median", "piece_pairs")
