"""Odd rows and clashing names in every stage, the pipeline as a whole, and sampling against all segmentations."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, toxicity
from tessera.llm.near_dup import near_duplicates, without_near_duplicates
from tessera.llm.pieces import lattice, model_path, sampled_pieces
from tessera.llm.sharding import interleave
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.tables import new_dir

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "l")]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.mark.parametrize("text", ["then", "of a", "banana"])
def test_samples_follow_all_segmentations(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    own = lattice(model_path(), 0.5)
    low, log_weight = int(own.ids.min()), {}
    for i in map(int, own.ids):
        log_weight[model.id_to_piece(i)] = -0.5 * np.log(i - low + 10.0)
    chances = []
    for unit in ("▁" + text).replace(" ", " ▁").split():
        own_ways = {}
        for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(unit)]
            parts = [unit[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if all(p in log_weight for p in parts):
                own_ways[tuple(parts)] = float(np.exp(sum(log_weight[p] for p in parts)))
        total = sum(own_ways.values())
        chances.append({p: w / total for p, w in own_ways.items()})
    want = {sum(ways, ()): float(np.prod([c[w] for c, w in zip(chances, ways, strict=True)])) for ways in itertools.product(*chances)}
    n = 40000
    got = Counter(tuple(model.id_to_piece(int(i)) for i in ids) for ids in own.encode([text] * n, np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)))
    assert set(got) <= set(want)
    assert all(abs(got[p] / n - c) < 0.015 for p, c in want.items())


def test_names_may_clash(spark):
    rows = [(1, "a b c d e\nx y", "s", 1, 2), (2, "a b c d e", "t", 3, 4), (None, None, None, None, None)]
    kind = "doc_id long, text string, source string, {} long, {} long"
    for a, b in (("_gone", "_doc"), ("_left", "_at"), ("_rank", "_deal"), ("_bin", "_s"), ("_known", "_part"), ("_n", "_row"), ("_own", "_key"), ("shard", "slot")):
        docs = spark.createDataFrame(rows, kind.format(a, b))
        out = line_dedup.without_repeated_lines(docs, 1)
        assert out.columns == docs.columns and {(r.doc_id, r[a]) for r in out.collect()} == {(1, 1), (None, None)}
        dealt = interleave(docs, 2)
        assert sorted(dealt.columns) == sorted({*docs.columns, "shard", "slot"}) and dealt.count() == 3
        if a != "shard":
            assert {(r.doc_id, r[a], r[b]) for r in dealt.collect()} == {(1, 1, 2), (2, 3, 4), (None, None, None)}


def test_repeated_and_null_keys_are_dealt_evenly(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(5)).alias("doc_id"), F.lit("hot").alias("source"), F.col("id").alias("x"))
    got = interleave(rows, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert {(r.n, r.m, r.d) for r in got} == {(1125, 1124, 1125)}


def test_repeated_ids_and_empty_tables_of_tokens(spark):
    import public_tokenizers

    path, root = public_tokenizers.path("byte_bpe_50k.json"), new_dir(spark, "tokens")
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x"), (None, None), (0, "")], "doc_id long, text string")
    got = read_token_files(write_token_files(docs, path, root), root).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == [(-1, 1), (-1, 2), (0, 1), (1, 2), (1, 2)]
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    root = new_dir(spark, "tokens")
    assert read_token_files(write_token_files(docs.limit(0), path, root), root).count() == 0


def test_toxicity_stands_empty_and_one_sided_tables(spark):
    docs = spark.createDataFrame([(i, prose(20, i), 1.0) for i in range(30)] + [(0, "again", 2.0), (None, None, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 32 and toxicity.toxicity(docs.limit(0), labels).count() == 0
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == 32


def test_pieces_stand_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    got = sorted(sampled_pieces(docs, model_path()).collect(), key=lambda r: r.doc_id or 0)
    assert len(got) == 4 and got[1].piece_ids == got[2].piece_ids and all(r.lossless for r in got)
    assert sampled_pieces(docs.limit(0), model_path()).count() == 0


def test_near_copies_of_long_texts_with_clashing_names(spark):
    long_ = prose(20000, 8)
    docs = spark.createDataFrame([(5, long_, 1, 2), (4, long_ + " zzz", 3, 4), (6, prose(20000, 9), 5, 6)], "doc_id long, text string, node long, root long")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()} == {4: 4, 5: 4, 6: 6}
    assert sorted(tuple(r) for r in without_near_duplicates(docs, 2).select("doc_id", "node", "root").collect()) == [(4, 3, 4), (6, 5, 6)]


def test_pipeline_runs_over_odd_documents(spark, tmp_path):
    item = prose(30, 600)
    texts = {1: prose(80, 1), 2: prose(80, 1) + " zzz", 3: prose(60, 3) + " scum idiot", 4: "intro\n" + item, 5: None, 6: "", 7: prose(50, 7) + "\n" + prose(40, 70), 8: prose(40, 70) + "\n" + prose(50, 8)}
    train = {100 + i: prose(60, 100 + i) + (" scum idiot" if i % 4 == 0 else "") for i in range(800)}
    rows = [(i, t, "en", "web", len(t or "")) for i, t in [*texts.items(), *train.items(), (1, texts[1]), (None, "no id here")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in out)
    assert kept[1] == 2 and kept[None] == 1 and kept[5] == 1 and kept[6] == 1 and kept[7] == 1 and kept[8] == 1
    assert kept[2] == 0 and kept[3] == 0 and kept[4] == 0
    assert sum(kept[100 + i] for i in range(800) if i % 4) > 590 and all(r.lossless for r in out)
    sizes = {r.doc_id: r.n_bytes for r in out}
    assert sizes[8] == len(prose(50, 8))


def test_new_links_join_known_components(spark):
    from tessera.llm.tables import components, joined

    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))]
    df = lambda part: spark.createDataFrame(part, "a long, b long")
    want = {r.node: r.root for r in components(df(links)).collect()}
    root = joined(joined(components(df(links[:100])), df(links[100:180])), df(links[180:]))
    assert {r.node: r.root for r in root.collect()} == want and root.count() == len(want)
    assert joined(root, df(links).limit(0)).count() == len(want)
