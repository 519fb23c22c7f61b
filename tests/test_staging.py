"""Rows staged into items and claims: every kind, merged names, places, held lineage, what is left over."""

import itertools

import pytest

from tessera.operators import staging as S

VOCAB = [
    ("technique", "offhand-blown", "Offhand Blown Glass", ["blown glass", "hot glass"], None, None), ("technique", "cane-murrine", "Cane & Murrine", ["cane"], None, None),
    ("technique", "boro", "Borosilicate Flameworking", [], None, "flameworking"), ("technique", "flameworking", "flameworking", ["lampwork"], None, None),
    ("occupation", "glass-artist", "Artist or Maker", [], None, None), ("occupation", "educator", "Educator", [], None, None), ("colour", "orange", "orange", [], None, None),
    ("event-type", "created", "created", [], None, None), ("event-type", "sold", "sold", [], None, None), ("event-type", "other", "other", [], None, None),
]
FORMS = {"pumpkin": "pumpkin", "pumpkins": "pumpkin", "vase": "vase"}


@pytest.fixture(scope="module")
def staged(spark):
    df = spark.createDataFrame
    tables = {
        "artists": df([
            ("a0", "Rae  Sutter", "Crozet, VA", "raesutter.com/my work[1]", "@rae.glass", "Blown Glass; Cane", "zzz", "Artist or Maker, Educator", "555", "x"), ("a1", "asdf", None, None, None, None, None, None, None, None),
            ("a2", "Ana Élan", "Venice, IT", "https://instagram.com/ana", "instagram.com/ana.e./", "hot glass vessel", None, "nan", None, None), ("a3", "RAE SUTTER", "Italy", None, None, None, None, None, None, None),
            ("a4", "x@y.z", None, None, None, None, None, None, None, None), ("a5", None, None, None, None, None, None, None, None, None),
        ], "_row_id string, artist_name string, based_in string, website string, instagram string, tech_primary string, tech_secondary string, roles string, phone string, favourite_colour string"),
        "museum_artists": df([("m0", "Museum of Glass", "rae sutter"), ("m1", "Museum of Glass", "New Person"), ("m2", "museum of glass", "new  person"), ("m3", "", "Ana Elan"), ("m4", "Lonely Museum", "test")], "_row_id string, museum string, artist string"),
        "commissions": df([("c0", "Ana Elan", "1999"), ("c1", "Third Maker", "c. 2001")], "_row_id string, artist string, year string"),
        "studios": df([("s0", "Lumen Hot Shop", "Crozet", "VA", "USA", "Hot Shop", "38.069", "-78.701", "est. 2009", "bit ly", "secret@x.y"), ("s1", "Öst", "Malmö", None, "Sverige", "Other", "0", "0", None, "ost.se", None), ("s2", "Cold Co", None, None, "CZ", None, "x", "1", None, None, None)],
            "_row_id string, name string, city string, state string, country string, type string, lat string, lng string, founded string, website string, email string"),
        "university_programs": df([("u0", "Hill College", "Glass BFA", "Toledo", "Ohio", None), ("u1", "Hill College", "Glass MFA", "Elsewhere", None, None), ("u2", "hill-college", "Hill College", None, None, None)], "_row_id string, institution string, program string, city string, region string, country string"),
        "funding": df([("f0", "Big Fund", "Grant"), ("f1", "a", None)], "_row_id string, funding_source string, type string"),
        "art_fairs": df([("e0", "Fair One", "Paris, France", "2024-05", "2024-05-09"), ("e1", "Fair Two", None, "sometime", None)], "_row_id string, fair string, location string, start string, end string"),
        "maker_events": df([("h0", "Open House", "Rae", "Lumen Hot Shop", "Barn", "Crozet", "Virginia", None, "2025-10-31", None, "pumpkins", "approved", "open"), ("h1", "Hidden", None, None, None, None, None, None, None, None, None, "approved", "draft")],
            "_row_id string, title string, host_name string, studio string, venue string, city string, region string, country string, starts string, ends string, piece_type string, listing string, status string"),
        "seasons": df([(1, "Pumpkin Hunt", "autumn", "hunt", "closed", "2024-09-01", "2024-10-01", None), (2, "Next", None, "next", "open", "2025-09-01", None, None), (3, "Draft", None, "d", "draft", None, None, None)], "id long, title string, theme string, slug string, status string, starts string, ends string, voting_closes string"),
        "season_entries": df([(10, 1, "o0", "Lumen Hot Shop", 12, "2024-09-02", "approved"), (11, 1, "o1", "New Shop", None, "2024-09-01", "approved"), (12, 2, "o0", None, 3, "2025-09-02", "approved"), (13, 1, "o2", None, 1, "2024-09-01", "pending")], "id long, season_id long, object_row_id string, studio string, edition_size int, created_at string, status string"),
        "season_votes": df([(10,), (10,), (11,), (13,)], "entry_id long"),
        "objects": df([
            ("o0", "Jack the vase", "Rae Sutter", "2024", "Blown glass", "118 × 112 × 134 mm", "hash0", "orange", "84", [("created", "2024-01", "Rae Sutter", "Lumen Hot Shop"), ("created", "2024-01", "Rae Sutter", "Lumen Hot Shop"), ("odd", None, None, "nowhere")]),
            ("o1", None, "Unknown Maker", "n/a", "blown, macramé", None, None, "mauve", "x", None), ("o2", "Loose", None, None, None, "big", None, None, None, []),
        ], "_row_id string, title string, maker string, year string, techniques string, dimensions string, content_hash string, colour string, rating string, events array<struct<event_type: string, event_date: string, actor: string, location: string>>"),
        "lineage_submissions": df([("l0", "Rae Sutter", "Ana Elan", "apprentice", "1998 to 2001", "Lumen Hot Shop"), ("l1", "Rae Sutter", "Nobody Known", None, None, None), ("l2", "Ana Elan", "ana élan", None, None, None)], "_row_id string, student_name string, mentor_name string, relation string, years string, where string"),
    }
    vocab = df(VOCAB, "kind string, id string, label string, alternatives array<string>, old array<string>, parent string").selectExpr("*", "CAST(NULL AS string) AS description")
    out = S.stage(tables, vocab, FORMS)
    items = {r.key: r for r in out.items.collect()}
    claims = {}
    for r in sorted(out.claims.collect(), key=lambda r: (r.key, r.n)):
        claims.setdefault((r.key, r.prop), []).append((r.value, r.extra, [(q.prop, q.value, q.extra) for q in r.quals]))
    return out, items, claims


def told(items, key):
    return items[key].kind, items[key].label, items[key].description, items[key].cls


def test_items_of_every_kind(staged):
    out, items, claims = staged
    assert len(items) == out.items.count()
    assert told(items, "reg:artists:a0") == ("person", "Rae Sutter", "glass artist, Crozet, Virginia", "reg:class:person") and told(items, "reg:artists:a3")[2] == "glass artist, Italy"
    assert told(items, "reg:museum_artists:m1") == ("person", "New Person", "glass artist held in museum collections", "reg:class:person")
    assert told(items, "reg:commissions:c1")[2] == "glass artist, award recipient" and told(items, "reg:award:annual-commission")[1] == "Annual Commission"
    assert told(items, "reg:museum:museum-of-glass") == ("museum", "Museum of Glass", "museum holding glass", "reg:class:museum") and "reg:museum:lonely-museum" not in items
    assert told(items, "reg:studios:s0") == ("studio", "Lumen Hot Shop", "hot shop in Crozet, Virginia", "reg:class:hot-shop") and told(items, "reg:studios:s1")[2:] == ("glass studio in Malmö, Sverige", "reg:class:studio")
    assert told(items, "reg:studios:s2")[2] == "glass studio in Czech Republic" and told(items, "reg:studio:new-shop")[1:3] == ("New Shop", "glass studio")
    assert told(items, "reg:school:hill-college")[1] == "Hill College" and {k for k in items if k.startswith("reg:university_programs:")} == {"reg:university_programs:u0", "reg:university_programs:u1"}
    assert told(items, "reg:funding:f0")[2] == "grant funding work in glass" and "reg:funding:f1" not in items
    assert told(items, "reg:art_fairs:e0")[1:] == ("Fair One", "art fair in Paris, France", "reg:class:art-fair") and told(items, "reg:maker_events:h0")[1:3] == ("Open House (2025)", "show or sale by Rae at Barn in Crozet") and "reg:maker_events:h1" not in items
    assert told(items, "reg:seasons:1")[1:3] == ("Pumpkin Hunt", "autumn") and "reg:seasons:3" not in items
    assert told(items, "reg:object:hash0")[1:3] == ("Jack the vase", "glass piece by Rae Sutter, 2024") and told(items, "reg:object:o2")[1:3] == ("Loose", "glass piece") and told(items, "reg:object:o1")[1] == "Untitled piece"
    assert told(items, "reg:maker:unknown-maker")[:3] == ("person", "Unknown Maker", "glass maker") and told(items, "reg:award:crowd-favourite")[1] == "Crowd Favourite"
    assert told(items, "reg:place:crozet-virginia") == ("place", "Crozet", "Virginia, United States", "reg:class:place") and told(items, "reg:place:virginia-united-states")[1:3] == ("Virginia", "United States")
    assert told(items, "reg:country:united-states")[:3] == ("country", "United States", "country") and told(items, "reg:country:sverige")[1] == "Sverige"
    assert {k for k in items if k.startswith("reg:artists:")} == {"reg:artists:a0", "reg:artists:a2", "reg:artists:a3"} and told(items, "reg:technique:boro")[1] == "Borosilicate Flameworking"


def test_claims_are_typed_and_resolved(staged):
    out, _, claims = staged
    rae, one = "reg:artists:a0", lambda k, p: [v for v, _, _ in claims.get((k, p), [])]
    assert claims[rae, "technique"] == [("reg:technique:offhand-blown", None, []), ("reg:technique:cane-murrine", None, [])] and one("reg:artists:a2", "technique") == ["reg:technique:offhand-blown"]
    assert one(rae, "occupation") == ["reg:occupation:glass-artist", "reg:occupation:educator"] and one(rae, "work location") == ["reg:place:crozet-virginia"] and one("reg:artists:a3", "work location") == ["reg:country:italy"]
    assert one(rae, "official website") == [] and one(rae, "Instagram username") == ["rae.glass"] and one("reg:artists:a2", "official website") == [] and one("reg:artists:a2", "Instagram username") == ["ana.e"]
    assert one(rae, "collection") == ["reg:museum:museum-of-glass"] and one("reg:museum_artists:m1", "collection") == ["reg:museum:museum-of-glass"]
    assert claims["reg:artists:a2", "award received"] == [("reg:award:annual-commission", None, [("point in time", "1999-00-00", "9")])] and claims["reg:commissions:c1", "award received"][0][2] == [("point in time", "2001-00-00", "9")]
    shop = "reg:studios:s0"
    assert one(shop, "coordinates") == ["38.06900,-78.70100"] and claims[shop, "inception"] == [("2009-00-00", "9", [])] and one(shop, "instance of") == ["reg:class:studio"] and one(shop, "located in") == ["reg:place:crozet-virginia"] and one(shop, "country") == ["reg:country:united-states"]
    assert one("reg:studios:s1", "coordinates") == [] and one("reg:studios:s1", "located in") == ["reg:place:malmo-sverige"] and one("reg:studios:s1", "official website") == ["https://ost.se"] and one("reg:studios:s2", "country") == ["reg:country:czech-republic"]
    assert one("reg:place:crozet-virginia", "located in") == ["reg:place:virginia-united-states"] and one("reg:place:crozet-virginia", "country") == ["reg:country:united-states"]
    assert one("reg:school:hill-college", "located in") == ["reg:place:toledo-ohio"] and one("reg:university_programs:u1", "part of") == ["reg:school:hill-college"]
    assert claims["reg:art_fairs:e0", "start time"] == [("2024-05-00", "10", [])] and one("reg:art_fairs:e0", "located in") == ["reg:place:paris-france"] and one("reg:art_fairs:e1", "start time") == []
    assert one("reg:maker_events:h0", "participant") == [shop] and one("reg:maker_events:h0", "form") == ["reg:form:pumpkin"] and claims["reg:maker_events:h0", "start time"] == [("2025-10-31", "11", [])]
    piece = "reg:object:hash0"
    assert one(piece, "maker") == [rae] and one(piece, "form") == ["reg:form:vase", "reg:form:pumpkin"] and one(piece, "colour") == ["reg:colour:orange"] and one(piece, "height") == ["134"] and one(piece, "width") == ["118"] and one(piece, "strength") == ["84"]
    assert claims[piece, "participant in"] == [("reg:seasons:1", None, [("point in time", "2024-09-01", "11"), ("series ordinal", "1", None)]), ("reg:seasons:2", None, [("point in time", "2025-09-01", "11")])]
    assert one(piece, "edition size") == ["12"] and one(piece, "made at") == [shop] and claims[piece, "award received"] == [("reg:award:crowd-favourite", None, [("point in time", "2024-10-01", "11")])]
    assert claims[piece, "story event"] == [("reg:event-type:created", None, [("point in time", "2024-01-00", "10"), ("subject named as", "Rae Sutter", None), ("location", shop, None)])] * 2 + [("reg:event-type:other", None, [])]
    assert one("reg:object:o1", "maker") == ["reg:maker:unknown-maker"] and one("reg:object:o1", "made at") == ["reg:studio:new-shop"] and one("reg:object:o1", "colour") == [] and claims["reg:object:o1", "participant in"][0][2][1] == ("series ordinal", "2", None)
    assert claims[rae, "student of"] == [("reg:artists:a2", None, [("subject named as", "apprentice", None), ("start time", "1998-00-00", "9"), ("end time", "2001-00-00", "9"), ("location", shop, None)])] and one("reg:artists:a2", "student") == [rae] and len(claims["reg:artists:a2", "student"][0][2]) == 3
    assert one("reg:technique:boro", "subclass of") == ["reg:technique:flameworking"]
    words = {(r.kind, r.part): r.n for r in out.unknown.collect()}
    assert words == {("technique", "zzz"): 1, ("technique", "macramé"): 1, ("technique", "blown"): 1, ("colour", "mauve"): 1, ("event-type", "odd"): 1}


def test_report_counts_what_was_used_and_left(staged):
    report = {r.tbl: (r.rows, r["items"], r.used, r.ignored) for r in staged[0].report.collect()}
    assert report["artists"] == (6, 3, ["artist_name", "based_in", "instagram", "roles", "tech_primary", "tech_secondary", "website"], ["favourite_colour"])
    assert report["museum_artists"][:2] == (5, 1) and report["commissions"][:2] == (2, 1) and report["university_programs"][:2] == (3, 3) and report["studios"][:2] == (3, 3) and report["objects"][:2] == (3, 3)
    assert "email" not in report["studios"][2] + report["studios"][3] and report["funding"][:2] == (2, 1)
    assert [(r.row, r.why) for r in staged[0].held.collect()] == [("l1", "mentor not found: Nobody Known")]


def test_held_rows_are_released_in_any_order(spark):
    df = spark.createDataFrame
    rows = [("1", "ann lee", "bo day", None, "1990", None), ("2", "bo day", "cy fox", "tutor", None, "kiln"), ("3", "dee", "ann lee", None, None, None), ("1", "ann lee", "bo day", None, "1990", None)]
    kind = "_row_id string, student string, mentor string, relation string, years string, where string"
    names = [("ann lee", "p:a"), ("bo day", "p:b"), ("cy fox", "p:c"), ("dee", "p:d")]
    shops = df([("kiln", "s:k")], "name string, key string")
    key = lambda frame: sorted(map(str, frame.collect()))
    want = key(S.lineage_links(df(rows, kind), df(names, "name string, key string"), shops)[0])
    assert len(want) == 6
    for order in itertools.permutations(range(3)):
        got, held, at = [], None, 0
        for step, i in enumerate(order):
            people = df(names[: 2 + step], "name string, key string")
            links, held = S.lineage_links(df([rows[i]], kind), people, shops, held)
            got, at = got + key(links), at + 1
            held = df(held.collect(), held.schema)
        assert sorted(got) == want and held.count() == 0
