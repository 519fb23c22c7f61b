"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Distinct vectors are dealt to shards of about SHARD by a hash. In a shard vectors are inserted in doubling batches: each
runs a greedy beam search from the medoid over the graph so far, and what it visits becomes its candidates; robust pruning
keeps the nearest and drops those that a kept one is nearer to by the factor ALPHA; reverse edges are added and lists
that overflow are pruned again. Nodes that no path from the medoid reaches get an edge from the nearest one that has room. A
query searches every shard with a beam of BEAM, and its best answers are merged. Searches run in single precision on vectors
less their shard's mean; scores are computed in double precision on the original ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import load, table

#: Queries that advance together, so that what they have seen stays small.
SHARD, DEGREE, ALPHA, BUILD_BEAM, BEAM, K, TOGETHER = 16384, 32, 1.2, 64, 160, 10, 512


def _beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest nodes found for each row of q, and their squared distances, by greedy search from start.

    Up to TOGETHER queries advance together: each expands its nearest unexpanded node until all of its beam is expanded.
    """
    n, m = len(x), len(q)
    if m > TOGETHER:
        parts = [_beam(x, norms, graph, start, q[i : i + TOGETHER], width) for i in range(0, m, TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ids = np.full((m, width), -1, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.zeros((m, width), bool)
    seen = np.zeros((m, n), bool)
    qn = (q * q).sum(1)
    ids[:, 0] = start
    dist[:, 0] = qn + norms[start] - 2 * q @ x[start]
    seen[:, start] = True
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        best = open_.argmin(1)
        some = np.isfinite(open_[np.arange(len(live)), best])
        live, best = live[some], best[some]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = qn[live[r]] + norms[near[r, c]] - 2 * np.einsum("ij,ij->i", q[live[r]], x[near[r, c]])
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argsort(all_d, 1, kind="stable")[:, :width]
        row = np.arange(len(live))[:, None]
        dist[live] = all_d[row, keep]
        ids[live] = np.where(np.isfinite(dist[live]), np.concatenate([ids[live], near], 1)[row, keep], -1)
        done[live] = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)[row, keep]
    return ids, dist


def _prune(x: np.ndarray, norms: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of the candidates (-1: none) of each node of p."""
    out = np.full((len(p), degree), -1, np.int64)
    for low in range(0, len(p), 256):
        own, c = p[low : low + 256], np.sort(cand[low : low + 256], 1)
        bad = (c < 0) | (c == own[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        v = x[np.maximum(c, 0)]
        d = norms[np.maximum(c, 0)] + norms[own][:, None] - 2 * np.einsum("ijk,ik->ij", v, x[own])
        d[bad] = np.inf
        for k in range(degree):
            j = d.argmin(1)
            row = np.arange(len(own))
            ok = np.isfinite(d[row, j])
            if not ok.any():
                break
            out[low : low + 256, k] = np.where(ok, c[row, j], -1)
            near = norms[np.maximum(c, 0)] + norms[np.maximum(c[row, j], 0)][:, None] - 2 * np.einsum("ijk,ik->ij", v, v[row, j])
            d[(ALPHA**2 * near <= d) & ok[:, None]] = np.inf
            d[row, j] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Out-edges of each row of x (-1: none), and the medoid, where searches begin."""
    n = len(x)
    norms = (x * x).sum(1)
    middle = x.mean(0)
    start = int((norms - 2 * x @ middle).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + max(16, at)]
        found, _ = _beam(x, norms, graph, start, x[batch], beam)
        graph[batch] = _prune(x, norms, batch, np.concatenate([found, graph[batch]], 1), degree)
        src = np.repeat(batch, degree)
        dst = graph[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        new = np.full((len(node), int(count.max(initial=0))), -1, np.int64)
        new[np.repeat(np.arange(len(node)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        graph[node] = _prune(x, norms, node, np.concatenate([graph[node], new], 1), degree)
        at += len(batch)
    return _connected(x, norms, graph, start), start


def _connected(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with edges added until every node can be reached from start."""
    reached = np.zeros(len(x), bool)
    front = np.array([start])
    while True:
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return graph
        room = np.flatnonzero(reached & (graph < 0).any(1))
        if not len(room):
            graph = np.concatenate([graph, np.full((len(graph), 1), -1, np.int64)], 1)
            continue
        node = lost[0]
        near = room[(norms[room] - 2 * x[room] @ x[node]).argmin()]
        graph[near, np.flatnonzero(graph[near] < 0)[0]] = node
        front = np.array([node])


def _single(x: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The arrays less the mean of x and scaled to it, in single precision: order and ratios of distances stay."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-300)
    mean = (x / scale).mean(0)
    spread = max(float(np.abs(x / scale - mean).max(initial=0)), 1e-300)
    return [((a / scale - mean) / spread).astype(np.float32) for a in (x, *more)]


def search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """The places of about the k nearest rows of x for each row of q, nearest first (-1: none)."""
    return _beam(x, (x * x).sum(1), graph, start, q, max(beam, k))[0][:, :k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of vectors that are not null or zero and have no null, NaN or infinite component."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & fine)


def nearest(vectors: DataFrame, every: int = 100, k: int = K, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found; queries are rows whose vec_id is divisible by `every`.

    score is the Euclidean distance in double precision on the original vectors; ties go to the smaller vec_id. Equal vectors
    are one node of the graph, with the k + 1 smallest vec_ids that have it, which is all that any answer can need. Rows that
    repeat a vec_id with one vector count once. Vectors of another length are never compared.
    """
    rows = table(usable(vectors).distinct(), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1)
    nodes = table(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("dim")).count().collect()  # a row for each vector length
    shards = max([1, *(-(-r["count"] // shard) for r in sizes)])
    placed = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def index(group: pa.Table) -> pa.Table:
        x = np.array(group["v"].to_pylist(), np.float64)
        order = np.lexsort(x.T[::-1])
        x = x[order]
        ids = group["ids"].to_pylist()
        graph, start = build_graph(_single(x)[0])
        flat = np.full((len(x), k + 1), -1, np.int64)
        for r, o in enumerate(order):
            flat[r, : len(ids[o])] = ids[o]
        row = {"dim": x.shape[1], "shard": group["shard"][0].as_py(), "n": len(x), "start": start, "x": x.tobytes(), "ids": flat.tobytes(), "graph": graph.astype(np.int32).tobytes()}
        return pa.table({c: [row[c]] for c in row}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("start", pa.int32()), ("x", pa.binary()), ("ids", pa.binary()), ("graph", pa.binary())]))

    made = table(placed.groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, n int, start int, x binary, ids binary, graph binary"), "index")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("dim"))
    count = queries.count()
    blocks = max(1, -(-count // 512))
    # Blocks of queries, each sent to every shard.
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(max(1, min(shards * blocks, 4096)), "block", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                n, dim = row.column("n")[0].as_py(), row.column("dim")[0].as_py()
                x = np.frombuffer(row.column("x")[0].as_buffer(), np.float64).reshape(n, dim)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), np.int64).reshape(n, -1)
                graph = np.frombuffer(row.column("graph")[0].as_buffer(), np.int32).reshape(n, -1)
                asked_ = row.column("queries")[0].as_py()
                out = []
                q = np.array([a["v"] for a in asked_], np.float64)
                xs, qs = _single(x, q)
                found = search(xs, graph, row.column("start")[0].as_py(), qs, k + 1, beam)
                for i, a in enumerate(asked_):
                    f = found[i][found[i] >= 0]
                    d = np.sqrt(((x[f] - q[i]) ** 2).sum(1))
                    hits = sorted((float(s), int(v)) for s, places in zip(d, ids[f], strict=True) for v in places if v >= 0 and v != a["vec_id"])
                    out += [(a["vec_id"], v, s) for s, v in hits[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    hits = asked.join(made, ["dim", "shard"]).mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of(spark, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))
