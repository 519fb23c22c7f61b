"""Retrieval loses no item that verification confirms: random cuts near the overlap, against brute force, items of 5 to 60 words."""

import numpy as np

from tessera.llm import decontam

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "l")]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if len(w) >= 5 else {tuple(w)}


def test_random_cuts(spark, monkeypatch):
    rng = np.random.default_rng(11)
    items = [(n, list(rng.choice(WORDS, n))) for n in range(5, 61)]
    rows = []
    for n, w in items:
        for share in (0.75, 0.8, 0.85):
            keep = max(1, round(share * n))
            low = int(rng.integers(0, n - keep + 1))
            cut = w[low : low + keep]
            other = list(w)
            for i in rng.choice(n, max(1, round((1 - share) * n / 5)), replace=False):
                other[i] = "zzz"
            rows += [(len(rows), cut), (len(rows) + 1, other)]
    rows = [(i, [*rng.choice(WORDS, 30), *w, *rng.choice(WORDS, 30)]) for i, w in rows]
    want = {i: sorted(n for n, w in items if 10 * len(shingles(w) & shingles(d)) >= 8 * len(shingles(w))) for i, d in rows}
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in rows] + [(None, " ".join(items[9][1]))], "doc_id long, text string")
    known = spark.createDataFrame([(n, " ".join(w)) for n, w in items for _ in range(2)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.leaks(docs, known).collect()}
    assert got.pop(None) == [items[9][0]]
    assert got == {i: x for i, x in want.items() if x} and len(got) > 60
    # In several parts, each with a part of the items, the same comes out; rows of one doc_id count as one.
    monkeypatch.setattr(decontam, "ITEM_BYTES", 3000)
    again = {r.doc_id: r.item_ids for r in decontam.leaks(docs.unionAll(docs), known).collect()}
    assert again.pop(None) == [items[9][0]] and again == got
    assert decontam.leaks(docs, known.limit(0)).count() == 0
    assert decontam.without_leaks(docs, known).count() == len(rows) + 1 - len(got)
