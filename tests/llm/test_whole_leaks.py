"""A passage is a leak by its share of the item's shingles alone, wherever words were changed."""

import numpy as np

from tessera.llm.decontam import leaks

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "l")]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_a_word_changed_at_any_place(spark):
    items = {n: list(np.random.default_rng(700 + n).choice(WORDS, n)) for n in (6, 9, 14, 20, 24, 29, 36, 40, 55)}
    rows, want = [], {}
    for item, words in items.items():
        copies = [[*words[:i], "zzz", *words[i + 1 :]] for i in range(item)] + [words[: item - d] for d in range(9)] + [words[d:] for d in range(9)]
        for copy in copies:
            if len(shingles(words) & shingles(copy)) / len(shingles(words)) >= 0.8:
                want[len(rows)] = [item]
            rows.append((len(rows), "some text before " + " ".join(copy) + " and after"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in leaks(docs, known).collect()}
    assert got == want and len(want) > 100
