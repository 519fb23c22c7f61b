"""Pairs inside a bucket are judged by their registers in the join, not as rows of their own."""

import numpy as np

from tessera.llm import near_dup


def test_lanes_agree_as_registers_do(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 16, (40, 256)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < np.linspace(0, 1, 40)[:, None], x, x ^ (1 << rng.integers(0, 16, x.shape))).astype(np.uint16)
    lanes = lambda a: near_dup._lanes(spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(a)], "node long, registers binary"))
    both = lanes(x).toDF("node", "ra").join(lanes(y).toDF("node", "rb"), "node").selectExpr("node", f"{near_dup._agree('ra', 'rb')} AS n")
    assert {r.node: r.n for r in both.collect()} == dict(enumerate((x == y).sum(1).tolist()))
    est = lambda c: (c / 256 - near_dup.COLLISION) / (1 - near_dup.COLLISION)
    assert est(near_dup.AGREE) >= near_dup.NEAR > est(near_dup.AGREE - 1)


def test_only_pairs_with_a_pivot_are_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > 0.12 else f"x{rng.integers(10**6)}" for w in base) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, plain = [], near_dup._estimates
    monkeypatch.setattr(near_dup, "_estimates", lambda pairs, nodes: asked.append(pairs) or plain(pairs, nodes))
    near_dup.near_duplicates(docs, 2).count()
    assert len(asked) == 3
