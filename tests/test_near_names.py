"""Near names by rarest words against all pairs."""

import random
from difflib import SequenceMatcher

from tessera.operators import resolution as E


def test_near_names_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["person", "studio", "of", "the", "lumen", "hot", "shop", "maria", "okafor", "a", "b", "glassworks", "international", "12", "7"]
    names = sorted({" ".join(sorted(rng.choices(words, k=rng.randint(1, 7)))) for _ in range(700)} | {"person", "person person", "aaaa bbbb cccc dddd eeee", "aaaa bbbb cccc dddd eeee f"})
    df = spark.createDataFrame([(f"k{i:04d}", n, n[:1]) for i, n in enumerate(names)] + [("k9999", names[0], names[0][:1]), ("x", "", ""), ("y", None, "a")], "key string, name string, block string")
    for threshold in (0.94, 0.8):
        want = set()
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                b = names[j]
                ta, tb = set(a.split()), set(b.split())
                if a[:1] == b[:1] and (len(ta ^ tb) <= 1 or ta <= tb or tb <= ta) and SequenceMatcher(None, a, b).ratio() >= threshold:
                    want.add((f"k{i:04d}", f"k{j:04d}"))
        got = {(r.a, r.b) for r in E.near_names(df, "key", "name", "block", threshold).collect()}
        assert got == want and want
