"""The whole sharding query against a plain ranking: sizes, checksums, shards and slots, with null texts, sources and ids."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding


@pytest.mark.parametrize("n,size", [(0, 16), (3, 16), (501, 16), (501, 4096)])
def test_equals_a_plain_ranking(spark, tmp_path, monkeypatch, n, size):
    monkeypatch.setattr(sharding, "BIN", size)
    rng = random.Random(n)
    rows = [(i if i % 50 else None, rng.choice(["text", "é漢🙂", "", None, "x" * 3000]) if i % 3 else f"own {i}", rng.choice(["a", "a", "a", "b", "", None]), "en", i) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    docs = own.select("doc_id", "source", "size", "text_crc32", "text", F.xxhash64("doc_id", "source", "size", "text_crc32").alias("own")).collect()
    each = []
    for d in docs:
        data = (d.text or "").encode()
        assert (d["size"], d.text_crc32) == (len(data) + 1, zlib.crc32(data))
        deal = hashlib.md5(f"17:{'null' if d.doc_id is None else d.doc_id}:{d.own}".encode()).hexdigest()
        each.append((d, (deal, -1 if d.doc_id is None else d.doc_id, d.own)))
    placed = []
    for source in {d.source for d, _ in each}:
        mine = sorted((x for x in each if x[0].source == source), key=lambda x: x[1])
        placed += [((r + 0.5) / len(mine), k[0], source or "", source is not None, *k[1:], d) for r, (d, k) in enumerate(mine)]
    placed.sort(key=lambda x: x[:-1])
    want = []
    for i, x in enumerate(placed):
        shard = i * 8 // n
        want.append((x[-1].doc_id, x[-1]["size"], x[-1].text_crc32, "rows", shard, i - math.ceil(shard * n / 8), None))
    got = [tuple(r)[:7] for r in sharding.shard_documents(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    counts = [sum(r[4] == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
