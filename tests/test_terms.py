"""Phrases inside texts by both ways against plain Python; the order in which a vocabulary decides."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, terms


@pytest.mark.parametrize("sent", [0, 10**6])
def test_contained_equals_plain_python(spark, sent):
    rng = random.Random(4)
    words = ["studio", "glass", "maker", "a", "éa", "no 12", "  ", "studio glass 7", "x" * 40]
    phrases = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)] + ["g", "aa", "é", "", "studio glass"]
    texts = ["".join(rng.choices([*words, " ", "s", "tudio"], k=rng.randint(0, 12))) for _ in range(80)] + ["", None, "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[1])], "id long, t string")
    got = terms.contained(df, spark.createDataFrame([(p,) for p in [*phrases, phrases[0], None]], "p string"), sent)
    rows = [(i, t) for i, t in [*enumerate(texts), (0, texts[1])] if t is not None]
    want = sorted((i, p, t.index(p)) for i, t in rows for p in set(phrases) if p and p in t)
    assert sorted(map(tuple, got.collect())) == want
    assert terms.contained(df, spark.createDataFrame([], "p string")).count() == 0


def test_mentions_find_names_inside_words(spark):
    texts = spark.createDataFrame([(1, "Learnt at  STUDIO Lumen in 1990"), (2, None), (3, "preStudio Lumenx"), (4, "studio")], "id long, text string")
    names = spark.createDataFrame([(10, "Studio Lumen"), (11, "studio  lumen"), (12, "stud"), (13, None), (10, "Studio Lumen")], "name_id long, name string")
    assert sorted(map(tuple, graph.text_mentions(texts, names).collect())) == [(1, 10), (1, 11), (3, 10), (3, 11)]


VOCAB = [
    ("cane-murrine", "Cane & Murrine", ["caning"], None), ("kiln-casting", "Kiln / Open-Mold Casting", ["kiln casting", "casting"], ["cast"]), ("cold", "Cold Working (Grinding)", [], ["coldworking"]),
    ("casting", "Other", None, None), ("neon", "Neon & Plasma Glass", ["plasma"], None), ("glass-a", "Glass", None, None), ("glass-b", "Glass", None, None),
]


def test_terms_resolve_by_precedence(spark):
    vocab = terms.vocabulary(spark.createDataFrame(VOCAB, "id string, label string, alternatives array<string>, old array<string>"))
    known = {r.term: (r.id, r.how) for r in vocab.collect()}
    assert known["casting"] == ("casting", "id") and known["glass"] == ("glass-a", "label") and known["cold working"] == ("cold", "old") and known["cast"] == ("kiln-casting", "old")
    cells = [(1, "Cane & Murrine; CASTING | coldworking"), (2, "blown, hot plasma glass work"), (3, None), (4, " ;; "), (5, "kiln casting of (a, b), Cold Working"), (6, "zzz; zzz; yyy")]
    out = terms.resolve_terms(spark.createDataFrame(cells, "id long, c string"), "id", "c", vocab)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.n)):
        got.setdefault(r.id, []).append((r.part, r.term_id, r.how))
    assert got[1] == [("Cane & Murrine", "cane-murrine", "label"), ("CASTING", "casting", "id"), ("coldworking", "cold", "old")]
    assert got[2] == [("blown", None, None), ("hot plasma glass work", "neon", "contained")]
    assert got[5] == [("kiln casting of (a, b)", "kiln-casting", "contained"), ("Cold Working", "cold", "old")]
    assert set(got) == {1, 2, 5, 6} and sorted(map(tuple, terms.unknown_terms(out).collect())) == [("blown", 1), ("yyy", 1), ("zzz", 1)]


def test_longest_matches_take_whole_words(spark):
    vocab = terms.vocabulary(spark.createDataFrame(VOCAB, "id string, label string, alternatives array<string>, old array<string>"))
    texts = spark.createDataFrame([(1, "Kiln  casting and CAST glass, glassy neon"), (2, ""), (3, None), (4, "plasma")], "id long, text string")
    got = sorted((r.id, r.start, r.end, r.term_id) for r in terms.longest_matches(texts, "id", "text", vocab).collect())
    assert got == [(1, 0, 12, "kiln-casting"), (1, 17, 21, "kiln-casting"), (1, 22, 27, "glass-a"), (1, 36, 40, "neon"), (4, 0, 6, "neon")]
    assert terms.longest_matches(texts, "id", "text", vocab.where(F.lit(False))).count() == 0


def test_folds_equal_unicode_decomposition(spark):
    import unicodedata

    from tessera.functions import text as T

    def plain(s):
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()).split())

    blocks = [chr(i) for lo, hi in ((0x20, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF00, 0xFF60)) for i in range(lo, hi)]
    texts = [f"a{c}b" for c in blocks] + ["Größe  ÉTÉ", "Å. Møller-Öst", "ﬁn ½ ™", "", "漢字"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    got = {r.t: (r.a, r.b) for r in df.select("t", T.fold(F.col("t")).alias("a"), T.fold_exact(F.col("t")).alias("b")).collect()}
    assert {t: got[t][1] for t in texts} == {t: plain(t) for t in texts} and got[None] == (None, None)
    single = [t for t, c in zip(texts, blocks, strict=False) if len(unicodedata.normalize("NFKD", c).encode("ascii", "ignore")) <= 1 and (c < "ɐ" or "Ḁ" <= c < "ἀ")]
    assert len(single) > 700 and {t: got[t][0] for t in single} == {t: plain(t) for t in single}
