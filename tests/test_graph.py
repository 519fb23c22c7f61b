"""The graph of small registries: people by name, structure before text, places of events, orphans."""

import pytest

from tessera.operators import graph as N


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame
    return N.build_graph(
        df([("Lino  Maestro", "Offhand Blown Glass | Cane & Murrine", "", "works at LUMEN HOT SHOP"), ("Rae Student", "offhand blown glass", "studied under lino maestro and Ann", None), (" ", "Neon", "x", "y"), ("Rae student", None, "nobody", "nothing")], "name string, techniques string, studied_under string, text string"),
        df([("LINO MAESTRO", "Casting, Cold", None), ("Ann", None, "based at Hot"), (None, "Kiln", "lumen hot shop")], "name string, technique string, text string"),
        df([("Lumen Hot Shop",), ("lumen hot shop",), ("Hot",), ("Far Away",), (None,)], "name string"),
        df([("o1", "Vase", "rae STUDENT", "Cane & Murrine, Casting | Casting", ["Lumen  hot shop, Crozet", "elsewhere"]), ("o2", " ", None, None, None), (None, "lost", "x", "y", None), ("o3", "Bowl", "New Maker", "Neon", [])], "id string, title string, maker string, techniques string, locations array<string>"),
        df([("Rae Student", "Lino Maestro", "apprentice"), ("Solo", "solo", None), ("Third", "Rae student", " "), (None, "x", "y")], "student string, mentor string, relation string"),
        df([("o1", "u1", "Col", "verified"), ("o1", "u1", "Col", "approved"), ("o1", "u2", None, "pending"), ("zz", "u3", "x", "verified"), ("o2", "u4", " ", "verified"), ("o1", "", "x", "verified")], "object_id string, collector_uid string, collector_name string, status string"),
        df([("o3", "o1", 0.9123)], "a string, b string, similarity double"), df([("Offhand Blown Glass",)], "label string"),
    )


def test_edges(built):
    got = {(r.src, r.type, r.dst): (r.confidence, r.weight, r.relation) for r in built[1].collect()}
    assert got[("artist:rae student", "studied_under", "artist:lino maestro")] == ("structured", 1.0, "apprentice") and got[("artist:third", "studied_under", "artist:rae student")][2] == "Studied under"
    assert {k for k in got if k[1] == "studied_under"} == {("artist:rae student", "studied_under", "artist:lino maestro"), ("artist:third", "studied_under", "artist:rae student")}
    assert {k[2] for k in got if k[0] == "artist:lino maestro" and k[1] == "uses"} == {"technique:offhand blown glass", "technique:cane & murrine", "technique:casting, cold"} and {k[2] for k in got if k[0] == "object:o1" and k[1] == "uses"} == {"technique:cane & murrine", "technique:casting"}
    assert got[("object:o1", "based_at", "studio:lumen hot shop")][0] == "event" and got[("artist:lino maestro", "based_at", "studio:lumen hot shop")][0] == "text" and sum(k[1] == "based_at" for k in got) == 2
    assert got[("object:o1", "made_by", "artist:rae student")] and got[("object:o3", "made_by", "artist:new maker")] and got[("object:o1", "similar_to", "object:o3")] == ("fingerprint", 0.912, None)
    assert {k[2] for k in got if k[1] == "collected_by"} == {"collector:u1", "collector:u4"}


def test_nodes(built):
    rows = built[0].collect()
    got = {r.id: (r.label, r.type, r.source) for r in rows}
    assert len(got) == len(rows)
    assert got["artist:lino maestro"] == ("Lino Maestro", "artist", "submission") and got["artist:ann"][2] == "directory" and got["artist:new maker"] == ("New Maker", "artist", "object") and got["artist:third"][2] == "lineage" and got["artist:rae student"][0] == "Rae Student"
    assert got["technique:offhand blown glass"][0] == "Offhand Blown Glass" and got["object:o2"][0] == "Untitled" and got["collector:u4"][0] == "a collector" and got["collector:u1"][0] == "Col"
    assert "studio:far away" not in got and "studio:hot" not in got and "technique:kiln" not in got and "artist:solo" not in got
