"""The guess cost is the minimum over all segmentations; base spans equal plain patterns on awkward texts."""

import math
import random
import re

from tessera.llm import secrets


def brute(value):
    low, n = value.lower(), len(value)
    one, ranks = secrets.brute_cost(value), secrets.FIXED.of

    def segment(i, j):
        costs = [one] if j - i == 1 else []
        part = low[i:j]
        if part in ranks and j - i >= 3:
            costs.append(secrets.word_cost(value[i:j], ranks[part]))
        if secrets.DATE.fullmatch(value[i:j]):
            costs.append(secrets.date_cost(j - i))
        if j - i >= 3 and len(set(part)) == 1:
            costs.append(secrets.JOIN + one + math.log10(j - i))
        if j - i >= 3 and all(p in secrets.STEPS for p in zip(part, part[1:], strict=False)):
            costs.append(secrets.JOIN + math.log10(60) + math.log10(j - i))
        return min(costs, default=math.inf)

    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + segment(i, j) for i in range(j))
    return best[n]


def test_cost_equals_brute_force():
    r = random.Random(4)
    parts = ["password", "ddddd", "1234", "asdfg", "1999", "12/31/1999", "2001-2-3", "20010203", "love", "x", "Q7", "sss", "dragon", "nop", "éé", "11", "aaa", "qwe", "89"]
    values = ["passwordddddddddd", "12341999", "passs", "11111999", "abcabcabc", "İstanbul1999", "a" * 60, "1" * 40, ""] + ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(400)]
    for v in values:
        assert abs(secrets.guess_cost(v) - brute(v)) < 1e-9, v
    assert secrets.guess_cost("passwordddddddddd") < 4


def test_long_values_take_little_time():
    assert secrets.guess_cost("a" * 20000) < 7 < secrets.guess_cost("x9" * 5000)


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    bits = ["password", "PassWD", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "é", "\n", "secret", "_", "x" * 9, "ſecret", "K"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for _ in range(2000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secrets.base_spans(text) == sorted(want), text


def test_odd_tables(spark):
    kind = "doc_id long, text string, spans string"
    assert secrets.find_secrets(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "token=abcdefgh1", "x"), (1, "token=abcdefgh1", "x"), (None, "pwd=" + "z9Kq" * 20000, None)]
    got = secrets.find_secrets(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or 0, r.n_assign) for r in got) == [(0, 0), (1, 1), (1, 1)]
    assert next(r.n_guess for r in got if r.doc_id is None) == 1
