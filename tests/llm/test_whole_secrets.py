"""The cost of guessing a value decides, not the classes of its characters; words of the documents are cheap."""

import itertools
import random
from collections import Counter

from tessera.llm import secrets


def test_values_of_one_class_are_found(spark):
    values = ["pwd=qjzkxwvplmtrgh", "bearer: 58203917462850193", "passphrase = QJZKXWVPLMTRGH", "private_key=xkvbqzjwmtpldr", "credentials is wqzkjxvbmtrplh"]
    cheap = ["secret is documentation", "passphrase: incorrect.", "pwd=aaaaaaaaaaaa", "pwd=12345678901234567", "bearer: 1234567890", "secret is documentation-incorrect", "token is qwertyuiop"]
    # Fifty copies don't make a secret a word.
    texts = values + [values[0]] * 50 + cheap + ["the documentation was incorrect"] * 5 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    found = {i for i, r in got.items() if r.n_guess}
    assert len(got) == len(texts) and found == set(range(len(values) + 50))
    for i in range(len(values)):
        kind, a, b = next(s.split(":") for s in got[i].spans.split(",") if s.startswith("guess"))
        assert texts[i].endswith(texts[i][int(a) : int(b)]) and int(b) - int(a) >= 14


def test_frequent_words_are_those_of_a_plain_count(spark, monkeypatch):
    rng = random.Random(7)
    names = ["".join(p) for p in itertools.product("bdk", "aeo", "lmn", "iu")]
    texts = [" ".join(rng.choices(names, range(1, len(names) + 1), k=40)) for _ in range(60)] + [None, "", "..."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = Counter(w for t in texts for w in (t or "").split() if w in names)
    order = sorted((-n, w) for w, n in counts.items() if n >= secrets.OFTEN)
    assert len({n for n, _ in order}) < len(order)
    for most in (1, 7, 20, len(order), 20_000):
        monkeypatch.setattr(secrets, "CORPUS_WORDS", most)
        assert secrets.corpus_words(docs) == [w for _, w in order][:most]
    assert secrets.corpus_words(docs.where("text IS NULL")) == []
