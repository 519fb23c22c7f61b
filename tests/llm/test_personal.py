"""Base spans against the plain patterns, reliabilities against simulated labelers, planted and clean texts."""

import hashlib
import random
import re
import time

import numpy as np

from tessera.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@", ".", "-", " ", "+", "1", "25", "255", "256", "0", "007", "(", ")", "é", "٣", "_", "%", "4111111111111111", "5500 0000 0000 0004", "+1 (743) 555-3824", "x@y.z", "1.2.3.4", "\n", "漢"]
    for size in (3, 8, 30, 80):
        for _ in range(4000 // size):
            text = "".join(rng.choices(parts, k=size))
            assert personal.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    start = time.time()
    for unit in ("a", "1", "a@", "1.", "+1", "1 ", "+", "A ", "Ab ", "@a", "a-", "x.y@"):
        text = unit * (400_000 // len(unit))
        base = personal.base_spans(text)
        personal.more_spans(text, base)
    assert time.time() - start < 60


def test_reliabilities_are_those_of_simulated_labelers():
    rng = np.random.default_rng(3)
    n, right, speaks = 40_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.75]), np.array([0.9, 0.5, 0.7, 0.8, 0.6, 0.9, 0.5])
    kinds = rng.integers(0, 9, n)
    share = np.linspace(0.2, 0.8, 9)
    truth = rng.random(n) < share[kinds]
    votes = np.where(rng.random((n, 7)) < speaks, np.where((rng.random((n, 7)) < right) == truth[:, None], 2, 0), 1)
    rows, counts = np.unique(np.column_stack([kinds, votes]), axis=0, return_counts=True)
    model = personal.estimate(rows[:, 0], rows[:, 1:], counts)
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.03 and np.abs(model.prior - share).max() < 0.05
    majority = ((votes - 1).sum(axis=1) > 0) == truth
    assert ((model.posterior(kinds, votes) > 0.5) == truth).mean() > majority.mean()


def test_planted_and_clean_texts(spark):
    rng = random.Random(5)
    first, last = ["Maria", "John", "Pierre", "Klaus", "Priya"], ["Okafor", "Brandt", "Silva", "Moreau", "Iyer"]
    words = "of the and their stone river light paper glass kiln".split()
    prose = lambda: " ".join(rng.choices(words, k=12))
    texts = []
    for _ in range(120):
        a, b = rng.choice(first), rng.choice(last)
        number = f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        texts.append(f"{prose()} contact {a} {b} or call {number} and write to {a.lower()}@mail.example.com {prose()}")
    clean = [f"{prose()} The Apache License Version 2.0 {prose()}", f"{prose()} At At At {prose()}", f"{prose()} between 1990-1995 and order 12 34 567 {prose()}", "Der Ofen Und Das Glas", "version 1.2.3 of 2021-03-04"] * 40
    odd = [None, "", "\x00", "é" * 1000, "+", "@", texts[0], texts[0]]
    every = texts + clean + odd
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(every)] + [(None, texts[1], None, None), (0, None, None, None)], "doc_id long, text string, c string, n_email int").repartition(5)
    rows = personal.find_personal(docs).collect()
    assert len(rows) == len(every) + 2
    got = {r.doc_id: r for r in rows if r.spans or r.doc_id != 0}
    for i, text in enumerate(every):
        base = plain(text or "")
        told = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
    kinds = [{s.split(":")[0] for s in got[i].spans.split(",")} for i in range(len(texts))]
    assert sum({"name", "number", "email"} <= k for k in kinds) >= 0.95 * len(texts)
    assert all(got[len(texts) + i].n_added == 0 for i in range(len(clean)))
    assert personal.find_personal(docs.limit(0)).count() == 0
