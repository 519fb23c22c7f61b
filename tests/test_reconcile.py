"""Candidates by name against a plain loop, and equal names without a ratio."""

import random
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import resolution


def plain(queries, items, top, least=60.0):
    out = set()
    norm = lambda s: " ".join(s.lower().split())
    parts = lambda n: {*n.split(" "), n[:2]}
    rounded = lambda s: float(Decimal(repr(s)).quantize(Decimal("0.1"), ROUND_HALF_UP))
    for q in queries:
        nq, found = norm(q), []
        for key, label, aliases in items:
            best = 0.0
            for n, own in [(norm(label), True), *((norm(a), False) for a in aliases or [])]:
                if parts(nq) & parts(n):
                    s = (100.0 if own else 99.0) if n == nq else max(100 * SequenceMatcher(None, nq, n).ratio(), 90.0 if own and set(nq.split(" ")) <= set(n.split(" ")) else 0.0)
                    best = max(best, s)
            if rounded(best) >= least:
                found.append((-rounded(best), label, key))
        found = sorted(found)[:top]
        exact = sum(-s >= 99 for s, _, _ in found) == 1
        out |= {(q, r + 1, key, -s, -s >= 99 and exact) for r, (s, _, key) in enumerate(found)}
    return out


@pytest.mark.parametrize("top", [1, 2, 5])
def test_candidates_equal_a_plain_loop(spark, top):
    rng = random.Random(top)
    name = lambda: " ".join(rng.choices(["Ann", "anna", "Studio", "studio", "of", "Lopez", "Lopes", "Oslo", "B"], k=rng.randint(1, 4)))
    items = [(f"k{i:03d}", name(), [name() for _ in range(rng.randint(0, 2))] or None) for i in range(120)]
    queries = sorted({name() for _ in range(40)} | {"Ann  STUDIO"})
    df = spark.createDataFrame(items, "key string, label string, aliases array<string>")
    got = resolution.reconcile(spark.createDataFrame([(q,) for q in queries], "query string"), df, top).collect()
    assert {tuple(r) for r in got} == plain(queries, items, top) and len(got) == len(plain(queries, items, top))


def test_equal_labels_need_no_ratio(spark, monkeypatch):
    @F.pandas_udf("double")
    def refused(a: pd.Series, b: pd.Series) -> pd.Series:
        raise ValueError("a ratio was asked for")

    monkeypatch.setattr(resolution, "ratio", refused)
    items = spark.range(300).selectExpr("CAST(id AS STRING) AS key", "concat('Studio ', CAST(id AS STRING)) AS label", "CAST(NULL AS ARRAY<STRING>) AS aliases")
    got = resolution.reconcile(items.select(F.col("label").alias("query")), items, top=1).collect()
    assert len(got) == 300 and all(r.query == f"Studio {r.key}" and r.score == 100.0 and r.match for r in got)
