"""Facts, fields, links and documents of records; who a name is; measurements taken anew; frames in SQL."""

import json

import pytest

from tessera.functions import tables as table_functions
from tessera.operators import records as R

QUAL = "array<struct<prop: string, kind: string, value: string, extra: string>>"


def test_facts_are_readable(spark):
    items = spark.createDataFrame([("reg:t:a", "Blown"), ("reg:unit:mm", "mm"), ("reg:s:1", "Shop")], "key string, label string")
    rows = [
        ("k", 3, "technique", "item", "reg:t:a", None, []), ("k", 1, "height", "quantity", "12", "reg:unit:mm", []), ("k", 2, "strength", "quantity", "84", None, []), ("k", 4, "made", "time", "+2024-01-02T00:00", "11", [("at", "item", "reg:s:1", None), ("by", "string", "x", None), ("no", "string", None, None)]),
        ("k", 5, "site", "url", "http://x", None, None), ("k", 6, "other", "item", "reg:zz", None, []), ("k", 7, "image URL", "url", "u", None, []), ("k", 8, "empty", "string", "", None, []), ("j", 1, "w", "quantity", "1", "reg:unit:in", []),
    ]
    claims = spark.createDataFrame(rows, f"key string, n int, prop string, kind string, value string, extra string, quals {QUAL}")
    got = {(r.key, r.n): (r.prop, r.value, r.item, r.url, r.qualifiers) for r in R.facts(claims, items).collect()}
    assert got == {
        ("k", 1): ("height", "12 mm", None, None, []), ("k", 2): ("strength", "84", None, None, []), ("k", 3): ("technique", "Blown", "reg:t:a", None, []), ("k", 4): ("made", "2024-01-02", None, None, ["at: Shop", "by: x"]),
        ("k", 5): ("site", "http://x", None, "http://x", []), ("k", 6): ("other", "reg:zz", "reg:zz", None, []), ("j", 1): ("w", "1 reg:unit:in", None, None, []),
    }
    assert R.facts(claims, items, most=2).count() == 3


def test_documents(spark):
    df = spark.createDataFrame
    items = df([("reg:artists:1", "person", "Ann  Lee", "", "artists", "1"), ("reg:studios:s", "studio", "Hot & Co", "a shop", "studios", "s"), ("reg:object:h", "object", "Vase", "", "objects", "o1"), ("reg:place:x", "place", "X", "", "places", None)], "key string, kind string, label string, description string, tbl string, row string")
    claims = df([("reg:artists:1", 1, "Instagram username", "ext", "ann.l", None, []), ("reg:studios:s", 1, "official website", "url", "https://hot.co", None, [])], f"key string, n int, prop string, kind string, value string, extra string, quals {QUAL}")
    tables = {
        "artists": df([("1", "Ann Lee", "Cane / Blown, x", "Crozet", "555", "f", "1980", "@insta")], "_row_id string, artist_name string, technique string, city string, phone string, gender string, birth_year string, instagram string"),
        "studios": df([("s", "Hot & Co", None)], "_row_id string, name string, website string"),
        "objects": df([("o1", "Vase", "ann LEE", "2020"), ("o2", "Cup", "Ann Lee", "2022"), ("o3", "Jar", "Ann Lee", None)], "_row_id string, title string, maker string, year string"),
        "season_entries": df([("Hot & co", "Ann", "approved"), ("Hot & Co", "ann", "approved"), ("Hot & Co", "Bob", "approved"), ("Hot & Co", "Zed", "pending")], "studio string, artist_name string, status string"),
    }
    held = df([("o1", "verified"), ("o1", "pending"), ("o1", "approved")], "object_row_id string, status string")
    got = {r.key: r for r in R.record_documents(items, claims, tables, None, held, most=2).collect()}
    assert len(got) == 4
    ann, shop, vase = got["reg:artists:1"], got["reg:studios:s"], got["reg:object:h"]
    assert ann.description == "cane glass artist, Crozet" and [(f.column, f.label, f.value) for f in ann.fields] == [("artist_name", "Artist name", "Ann Lee"), ("technique", "Technique", "Cane / Blown, x"), ("city", "City", "Crozet"), ("instagram", "Instagram", "@insta")]
    assert ann.links == {"maker": "/maker.html?m=reg%3Aartists%3A1", "directory": "/explore/?view=datasets&q=Ann%20%20Lee", "instagram": "https://www.instagram.com/insta/"}
    assert ([p.title for p in ann.pieces], ann.n_pieces) == (["Cup", "Vase"], 3) and ann.collected is None
    assert shop.description == "a shop" and shop.links["website"] == "https://hot.co" and shop.links["map"] == "/studios.html?q=Hot%20%26%20Co" and [(m.maker, m.entries) for m in shop.makers] == [("Ann", 2), ("Bob", 1)]
    assert vase.description == "glass piece by ann LEE, 2020" and vase.collected == 2 and vase.links == {"piece": "/explore/?view=objects&piece=o1", "image": "/api/objects/o1/image"} and got["reg:place:x"].description == "place"
    assert [r.key for r in R.record_documents(items, claims, tables, df([("reg:object:h",), ("reg:none",)], "key string")).collect()] == ["reg:object:h"]


def test_identities(spark):
    df = spark.createDataFrame
    asked = df([("a", ["Nobody", " ann LEE "], False), ("b", ["Bob"], False), ("c", ["Ghost"], False), ("d", [], True), ("e", ["Cy"], False), ("f", ["Dee"], False), ("g", ["Seen Once"], None)], "id string, names array<string>, account boolean")
    directory = df([("reg:artists:9", "Ann Lee"), ("reg:artists:8", "ann  lee"), ("reg:profiles:1", "Cy")], "key string, name string")
    items = df([("reg:maker:bob", "person", "Bob"), ("reg:artists:b", "person", "bob "), ("reg:profiles:1", "person", "Cyrus"), ("reg:studio:dee", "studio", "Dee")], "key string, kind string, label string")
    got = {r.id: (r.name, r.key, r.row_key, r.item_key, r.seen) for r in R.maker_identities(asked, directory, items, df([("seen once",), (None,)], "name string")).collect()}
    assert got == {
        "a": ("Ann Lee" if got["a"][2] == "reg:artists:9" else "ann  lee", "reg:artists:8", "reg:artists:8", None, False), "b": ("bob ", "reg:artists:b", None, "reg:artists:b", False), "d": ("A maker", None, None, None, False),
        "e": ("Cyrus", "reg:profiles:1", "reg:profiles:1", "reg:profiles:1", False), "g": ("Seen Once", None, None, None, True),
    }


def test_measured_anew(spark):
    rows = [(1, "a", [1.0, 2.0], 3.0, None, 3.0, 5.0), (2, "a", [2.0], 1.0, 9.0, 2.0, 9.0), (3, "b", [], 4.0, 4.0, 4.0, 4.0), (4, "b", None, None, 1.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, kind string, x array<double>, width double, height double, true_width double, true_height double").repartition(3)

    def measure(batch):
        return [{"width": sum(x), "height": max(x)} if x else {} for x in batch.column("x").to_pylist()]

    done = R.reprocess(df, ["width", "height"], measure, ["x"])
    got = {r.id: (r.now_width, r.now_height, r.change_width, r.error_width, r.was_width) for r in done.collect()}
    assert got == {1: (3.0, 2.0, 0.0, 0.0, 0.0), 2: (2.0, 2.0, 1.0, 0.0, -1.0), 3: (None, None, None, None, 0.0), 4: (None,) * 5}
    stats = {(r.kind, r.measure): (r.n, r.gained, r.lost, r.changed, r.mean_error, r.mean_abs_error, r.rmse, r.was_abs_error, r.better) for r in R.reprocess_report(done, ["width", "height"], ["kind"]).collect()}
    assert stats[("a", "width")] == (2, 0, 0, 1, 0.0, 0.0, 0.0, 0.5, 1) and stats[("a", "height")][:4] == (2, 1, 0, 1) and stats[("a", "height")][4] == -5.0 and stats[("b", "width")][:4] == (2, 0, 1, 0)
    with pytest.raises(Exception, match="one row for each"):
        R.reprocess(df, ["width"], lambda batch: [], ["x"]).collect()


def test_frames_in_sql(spark):
    table_functions.register(spark)
    texts = [json.dumps({"frames": [{"emb": [1, 2], "cell": "a"}, None, {"file": "f.jpg", "sector": 3, "seq": 9, "emb": "no"}]}), "no json", None, "[1]", '{"frames": 5}']
    spark.createDataFrame(list(enumerate(texts)), "id long, fp string").createOrReplaceTempView("prints")
    got = spark.sql("SELECT id, f.* FROM prints, LATERAL frames(fp, 'emb, dhash') f ORDER BY id, seq").collect()
    assert [tuple(r) for r in got] == [(0, 1, "frames/000.jpg", "a", -1, [1.0, 2.0], None), (0, 9, "f.jpg", "cf.jpg", 3, None, None)]
    assert spark.sql("SELECT count(*) FROM prints, LATERAL frames(fp, '') f").first()[0] == 2
    with pytest.raises(Exception, match="no such fields"):
        spark.sql("SELECT * FROM frames('{}', 'zzz')").collect()


def test_review_tables(spark):
    items = spark.createDataFrame([("a", "A", "x"), ("b", "B", None), ("c", "", "y")], "key string, label string, description string")
    claims = spark.createDataFrame([("a", 2, "p", "item", "b", None, []), ("a", 1, "p", "item", "c", None, []), ("a", 3, "p", "string", "b", None, []), ("b", 1, "q", "time", "2024", "9", []), ("b", 2, "registry key", "ext", "z", None, []), ("zz", 1, "r", "string", "v", None, [])], f"key string, n int, prop string, kind string, value string, extra string, quals {QUAL}")
    out = R.review_table(items, claims)
    assert out.columns == ["key", "label", "description", "p", "q"]
    assert {r.key: (r.p, r.q) for r in out.collect()} == {"a": ("c | b [B] | b", ""), "b": ("", "2024"), "c": ("", "")}


def test_pieces_boards_and_summaries(spark, tmp_path):
    pieces = spark.createDataFrame([("1", "Blue  Vase", "Ann Lee", "Cane", None), ("2", "Cup", "ann  lee", None, "50% blue"), ("3", None, None, "x", None)], "_row_id string, title string, maker string, techniques string, description string")
    ids = lambda **k: sorted(r._row_id for r in R.filter_pieces(pieces, **k).collect())
    assert ids() == ["1", "2", "3"] and ids(q=" BLUE ") == ["1", "2"] and ids(q="blue vase", maker="ANN LEE") == ["1"] and ids(piece=" 2 ") == ["2"] and ids(q="%x") == []
    rows = spark.createDataFrame([("1", "old", "a@b", 1), ("2", "new", "c@d", 5), ("3", "no", None, 9), ("4", "undated", None, None)], "_row_id string, title string, email string, _imported_at int")
    approvals = spark.createDataFrame([("jobs", "1", "approved"), ("jobs", "2", "approved"), ("jobs", "3", "rejected"), ("other", "3", "approved"), ("jobs", "4", "approved")], "tbl string, row_id string, status string")
    assert [tuple(r) for r in R.board_listing(rows, "jobs", approvals).collect()] == [("2", "new"), ("1", "old"), ("4", "undated")]
    for name, text in (("a.json", '{"kwh": 3.5, "count": 2, "cost": "7"}'), ("b.json", '{"energy_kwh": 1, "kwh": 9}'), ("c.json", "[1]"), ("d.json", "broken {")):
        (tmp_path / name).write_text(text)
    got = R.read_studio_summaries(spark, str(tmp_path), {"firings": ["firings", "count"], "energy": ["energy_kwh", "kwh"], "cost": ["cost_usd", "cost"]})
    assert sorted(map(tuple, got.collect())) == [("a", True, 2.0, 3.5, 0.0), ("b", True, 0.0, 1.0, 0.0), ("c", False, 0.0, 0.0, 0.0), ("d", False, 0.0, 0.0, 0.0)]
