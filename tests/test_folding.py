"""Clusters folded into canonical items, benches of verdicts, snapshots pruned, edges of paths."""

from pyspark.sql import functions as F

from tessera.operators import graph, matching, resolution, tables

QUAL = "array<struct<prop: string, kind: string, value: string, extra: string>>"


def test_clusters_fold(spark):
    rows = [
        ("a", "person", "Ann", "x", ["A."], "objects", "new", None, "1"), ("b", "person", "Ann L", "longer", ["Ann", "Annie"], "artists", "pushed", None, "1"), ("c", "person", "AL", None, None, "artists", "split", None, "1"),
        ("d", "person", "Bo", "", [], "artists", "pushed", None, "2"), ("e", "person", "Bo", "", [], "objects", "pushed", "Q1", "2"), ("f", "person", "Bo", "", [], "objects", "new", "Q2", "2"), ("g", "person", "Cy", "", [], "objects", "duplicate", "Q3", "3"), ("h", "person", "Dee", "", [], "objects", "duplicate", None, "4"), ("i", "person", "Eve", "", ["E"], "objects", "ready", None, "5"),
    ]
    items = spark.createDataFrame(rows, "key string, kind string, label string, description string, aliases array<string>, tbl string, status string, qid string, cluster string")
    claims = spark.createDataFrame([("a", 1, "p", "item", "x", None, []), ("a", 2, "q", "string", "y", None, []), ("b", 1, "p", "item", "x", None, []), ("c", 1, "p", "item", "z", None, []), ("i", 1, "p", "item", "x", None, []), ("f", 1, resolution.KEY_PROP, "ext", "old", None, []), ("e", 1, "p", "item", "w", None, []), ("e", 2, "p", "item", "v", None, [])], f"key string, n int, prop string, kind string, value string, extra string, quals {QUAL}")
    out, folded = resolution.fold_clusters(items, claims)
    got = {r.key: (r.status, r.canonical, r.cluster, r.note, r.aliases) for r in out.collect()}
    assert got["b"] == ("changed", None, "c:b", None, ["Ann", "Annie", "A."]) and got["a"] == ("duplicate", "b", "c:b", "same person as b", ["A."]) and got["c"] == ("split", None, "c:b", None, [])
    assert got["e"] == ("changed", None, "c:e", None, []) and got["d"][:4] == ("duplicate", "e", "c:e", "same person as e") and got["f"][:4] == ("duplicate", "e", "c:e", "also published as Q2")
    assert got["g"] == ("ready", None, None, None, []) and got["h"][0] == "new" and got["i"] == ("ready", None, None, None, ["E"])
    told = {}
    for r in sorted(folded.collect(), key=lambda r: (r.key, r.n)):
        told.setdefault(r.key, []).append((r.prop, r.value))
    assert told["b"] == [("p", "x"), ("q", "y"), (resolution.KEY_PROP, "a")] and told["e"] == [("p", "w"), ("p", "v"), (resolution.KEY_PROP, "d"), (resolution.KEY_PROP, "f")] and told["a"] == [("p", "x"), ("q", "y")] and told["i"] == [("p", "x")]


def test_benches(spark):
    rows = [(1, 2, "x", "x", 90, "match"), (2, 1, "x", "x", 60, "inconc"), (1, 3, "x", "y", 75, "match"), (3, 1, "y", "x", 10, "nomatch"), (1, 4, "x", "z", 40, "insufficient"), (4, 4, "z", "z", 100, "match")]
    pairs = spark.createDataFrame(rows, "q long, r long, q_label string, r_label string, confidence int, verdict string")
    r = matching.bench_report(pairs).first()
    assert (r.positives, r.negatives, r.true_accepts, r.false_accepts, r.true_rejects, r.positives_inconclusive, r.negatives_insufficient) == (2, 3, 1, 1, 1, 1, 1)
    assert (r.precision, r.recall, r.false_accept_rate, r.separation, r.piece_pairs, r.false_piece_pairs, r.rate_upper_95) == (0.5, 0.5, 0.333, -15, 2, 1, None) and (r.same_median, r.other_mean) == (75.0, 41.7)
    assert matching.bench_report(pairs.where("verdict <> 'match' OR q_label = r_label")).first().rate_upper_95 == 1.5
    got = [(x.kind, x["rank"], x.q, x.r) for x in matching.bench_extremes(pairs, 2).collect()]
    assert sorted(got) == [("weakest_positive", 1, 2, 1), ("weakest_positive", 2, 1, 2), ("worst_negative", 1, 1, 3), ("worst_negative", 2, 1, 4)]
    scored = pairs.where("q <> r").select(F.col("confidence").alias("score"), (F.col("q_label") == F.col("r_label")).alias("same"))
    assert tuple(matching.best_cut(matching.match_bench(scored)).first()) == (41, 1.0, 0.333, 0.667)
    assert matching.best_cut(matching.match_bench(scored.where("same"))).count() == 0


def test_snapshots_are_pruned(spark, tmp_path):
    df = spark.range(3)
    for stamp in ("20240101", "20240103", "20240102"):
        tables.snapshot(df, f"{tmp_path}/s", stamp)
    assert tables.prune(spark, f"{tmp_path}/s", 2) == ["20240101"] and tables.prune(spark, f"{tmp_path}/s", 2) == []
    assert [r.stamp for r in tables.snapshots(spark, f"{tmp_path}/s").collect()] == ["20240103", "20240102"]


def test_paths_have_edges_and_no_end(spark):
    n = 70
    nodes = spark.createDataFrame([(f"n{i}", f"N{i}", "t") for i in range(n + 1)], "id string, label string, type string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "up") if i % 2 else (f"n{i + 1}", f"n{i}", "down") for i in range(4)] + [("n0", "n2", "over"), ("n1", "n1", "loop")], "src string, dst string, type string")
    path = graph.shortest_path(nodes, edges, "n0", "n4")
    assert [(r.step, r.id) for r in path.orderBy("step").collect()] == [(0, "n0"), (1, "n2"), (2, "n3"), (3, "n4")]
    assert sorted(map(tuple, graph.path_edges(path, edges).collect())) == [(0, "n0", "n2", "over"), (1, "n3", "n2", "down"), (2, "n3", "n4", "up")]
    near = graph.neighbors(nodes, edges, "n0", 2)
    assert {(r.src, r.dst) for r in graph.neighbor_edges(edges, near, "n0", 1).collect()} == {("n1", "n0"), ("n0", "n2")}
    assert {(r.src, r.dst) for r in graph.neighbor_edges(edges, near, "n0", 2).collect()} == {("n1", "n0"), ("n0", "n2"), ("n1", "n2"), ("n3", "n2"), ("n1", "n1")}
