"""Products of groups, against a plain loop, held a few groups at a time."""

import random

from tessera.operators import commitments

P = 2**127 - 1


def test_products_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(commitments, "HELD", 5)
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", *(f"k{i}" for i in range(40))]), None if rng.random() < 0.1 else hex(rng.randrange(P))) for _ in range(3000)] + [("none", None)]
    want: dict = {}
    for key, x in rows:
        if x is not None:
            want[key] = want.get(key, 1) * int(x, 16) % P
    df = commitments.modular_product(spark.createDataFrame(rows, "key string, c string").repartition(3), "key", "c", P)
    got = [tuple(r) for r in df.collect()]
    assert dict(got) == {k: hex(v) for k, v in want.items()} and len(got) == len(want)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    nans = spark.createDataFrame([(float("nan"), "0x2"), (float("nan"), "0x3"), (1.0, "0x5")], "key double, c string")
    assert sorted(r["product"] for r in commitments.modular_product(nans, "key", "c", P).collect()) == ["0x5", "0x6"]
