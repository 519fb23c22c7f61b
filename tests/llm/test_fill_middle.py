"""Fill-in-middle against a plain loop over code points, and the exact round trip."""

import hashlib
import random
import re

from tessera.llm.fill_middle import fill_middle, restored


def plain(doc_id, text, rate=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", len(p), len(m)


def test_equals_a_plain_loop_and_comes_back(spark):
    rng = random.Random(3)
    parts = ["word", "A", "Zz", " ", "\n", "\x00", "é", "ß", "漢字", "🙂", "<", "<S", "P>", "1", "́", "\x7f", "<P", ">"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a", "é", "<P>", "x<S>y", "<M>", "\n" * 50, "ab" * 300_000, "é1 " * 100_000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (7, "another row of id 7"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n int, form string")
    for rate, spm in ((90, 20), (100, 50)):
        got = restored(fill_middle(docs, rate=rate, spm=spm)).collect()
        assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in got))) == sorted(map(repr, ((i, *plain(i, t, rate, spm), t or "") for i, t in rows)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert restored(fill_middle(docs.limit(0))).count() == 0
