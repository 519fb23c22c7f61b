"""Archives and corpora that are whole, broken, huge, nested, repeated; the columns of a session."""

import io
import json
import zipfile

import pytest

from tessera.sources import sessions as S

JPG, PNG = b"\xff\xd8\xff" + b"x" * 50, b"\x89PNG\r\n\x1a\n" + b"y" * 20


def packed(files, kind=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_give_rows_or_codes(spark, tmp_path, monkeypatch):
    man = ("session/Manifest.json", json.dumps({"kind": "enroll"}))
    good = packed([man, ("images/000.jpg", JPG), ("hero.PNG", PNG), ("../../etc/x.jpg", JPG + b"1"), ("a/b/x.jpg", JPG + b"22"), ("notes.txt", b"hi"), ("fake.jpg", b"no picture"), ("inner.zip", packed([man])), ("images/images/9.jpg", JPG), ("d/", b"")])
    cut = packed([man, ("images/000.jpg", JPG * 400)])
    files = {
        "good.zip": good, "text.zip": b"hello", "json.json": b'{"kind": "verify"}', "list.json": b"[1]", "latin.json": b'{"a": "\xff"}', "cut.zip": cut[: len(cut) // 2], "nomanifest.zip": packed([("images/0.jpg", JPG)]),
        "badmanifest.zip": packed([("manifest.json", b"{"), ("images/0.jpg", JPG)]), "listmanifest.zip": packed([("manifest.json", b"[]")]), "many.zip": packed([man, *((f"f{i}.txt", b"") for i in range(S.MOST_FILES))]),
        "bigfile.zip": packed([man, ("images/0.jpg", JPG + b"0" * S.MOST_FILE)]), "bigmanifest.zip": packed([("manifest.json", b'"' + b"0" * S.MOST_MANIFEST + b'"')]), "flipped.zip": (x := packed([man, ("images/0.jpg", JPG)], zipfile.ZIP_STORED)).replace(b"x" * 40, b"z" * 40),
        "twice.zip": packed([man, ("x.jpg", JPG), ("images/x.jpg", PNG), ("manifest.json", b"{")]),
    }
    assert x
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(S, "MOST_ZIP", 1 << 20)
    (tmp_path / "huge.zip").write_bytes(b"PK" + b"0" * (1 << 20))
    rows = S.load_session_zips(spark, str(tmp_path)).collect()
    said = {r.path.rsplit("/", 1)[-1]: (json.loads(r.manifest) if r.manifest else None, r.error) for r in rows if r.role == "session"}
    assert said == {
        "good.zip": ({"kind": "enroll"}, None), "text.zip": (None, "neither_zip_nor_json"), "json.json": ({"kind": "verify"}, None), "list.json": (None, "not_an_object"), "latin.json": (None, "neither_zip_nor_json"), "cut.zip": (None, "bad_zip"),
        "nomanifest.zip": (None, "no_manifest"), "badmanifest.zip": (None, "bad_manifest"), "listmanifest.zip": (None, "not_an_object"), "many.zip": (None, "too_many_files"), "bigfile.zip": (None, "file_too_large"), "bigmanifest.zip": (None, "manifest_too_large"),
        "flipped.zip": (None, "bad_zip"), "twice.zip": ({"kind": "enroll"}, None), "huge.zip": (None, "too_large"),
    }
    pictures = sorted((r.path.rsplit("/", 1)[-1], r.name, r.size, bytes(r.data)) for r in rows if r.role == "image")
    assert pictures == [("good.zip", "images/000.jpg", 53, JPG), ("good.zip", "images/9.jpg", 53, JPG), ("good.zip", "images/hero.PNG", 28, PNG), ("good.zip", "images/x.jpg", 55, JPG + b"22"), ("twice.zip", "images/x.jpg", 28, PNG)]


def test_uploads_of_a_table(spark):
    rows = S.unpack_uploads(spark.createDataFrame([("a", bytearray(b"")), ("b", None), ("c", bytearray(b"{}"))], "path string, content binary")).collect()
    assert sorted((r.path, r.error, r.manifest) for r in rows) == [("a", "empty", None), ("b", "empty", None), ("c", None, "{}")]


@pytest.mark.parametrize("name,want", [("images/000.jpg", "images/000.jpg"), ("hero.jpg", "images/hero.jpg"), ("..\\x.jpg", None), ("/x.jpg", None), (".hid.jpg", None), ("a/b.jpg", None), ("x.gif", None), ("", None), ("a b.jpg", None), ("a..b.jpg", None)])
def test_names_stay_inside(name, want):
    assert S.safe_name(name) == want


def test_sessions_are_indexed(spark):
    full = {
        "kind": "VERIFY", "app": {"version": "1.2"}, "device": {"ua": "Mozilla/5.0 (Linux; Android 14; Pixel 8) Chrome/120", "resolution": {"w": 1920, "h": 1080}, "compass": False}, "object": {"id": "12", "row_id": "r", "title": "T"},
        "match": {"verdict": "match", "confidence": "81.5", "descriptor": "dino", "shots": 9}, "fingerprint": {"rating": 84.5, "frames": [{"emb": [1]}, {}]}, "candidates": {"items": [{"title": "A", "confidence": 80.4}, {}]}, "decision": {"decision": "match_confirmed", "note": "n"},
    }
    ref = {"reference": {"kind": "mine", "id": 5.5, "title": "R", "rating": "x"}, "session": {"shots": 3, "descriptor": "color"}, "decision": {"decision": "other"}, "candidates": {"items": [{"ref": "r1", "label": "Inconclusive", "confidence": 12}]}}
    odd = [full, ref, {"reference": {"kind": "public", "id": "pub"}, "fingerprint": [], "match": "no", "candidates": {"items": "none"}, "object": {"id": "x1"}}, [], {"decision": {"object": {"id": 7}}, "kind": "zzz"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(odd)] + [(5, "{"), (6, None)], "id long, m string")
    got = {r.id: r for r in S.session_index(df, "id", "m").collect()}
    r = got[0]
    assert (r.kind, r.app_version, r.object_id, r.object_row_id, r.object_title, r.decision, r.decision_note, r.verdict, r.confidence, r.rating, r.descriptor, r.n_frames, r.has_embeddings, r.top_candidate, r.top_score, r.n_candidates) == ("verify", "1.2", 12, "r", "T", "match_confirmed", "n", "match", 82, 84, "dino", 2, True, "A", 80, 2)
    assert r.device == "Pixel 8 · Android 14 · Chrome · 1920×1080 · no compass"
    r = got[1]
    assert (r.kind, r.object_id, r.object_row_id, r.object_title, r.decision, r.verdict, r.confidence, r.rating, r.descriptor, r.n_frames, r.has_embeddings, r.top_candidate, r.n_candidates) == ("verify", 6, None, "R", "undecided", "Inconclusive", 12, None, "color", 3, False, "r1", 1)
    assert (got[2].kind, got[2].object_row_id, got[2].object_id, got[2].confidence, got[2].n_candidates) == ("verify", "pub", None, None, 0) and got[4].object_id == 7 and got[4].kind == "enroll"
    assert all((got[i].kind, got[i].decision, got[i].n_frames, got[i].device) == ("enroll", "undecided", 0, "") for i in (3, 5, 6))


def test_corpus_lines_in_order(spark, tmp_path):
    one = [{"object_id": "a", "embedding_centroid": []}, {"object_id": "a", "embedding_centroid": [1, 2.5], "title": "first", "techniques": ["t", None, ""], "traits": {"f": ["x"], "g": [], "h": "no"}}, {"object_id": 7, "embedding_centroid": [1], "dominant_colour": {"name": "red"}}]
    two = [{"object_id": "a", "embedding_centroid": [9]}, {"object_id": 0, "embedding_centroid": [9]}, {"object_id": "b", "embedding_centroid": ["x"]}, {"object_id": "c", "embedding_centroid": {"0": 1}}, {"embedding_centroid": [1]}]
    (tmp_path / "1.jsonl").write_text("\n".join([*map(json.dumps, one), "", "  ", "{broken", "[1]", '"text"']) + "\n")
    (tmp_path / "2.jsonl").write_text("\n".join(map(json.dumps, two)))
    records, left = S.read_corpus_jsonl(spark, str(tmp_path))
    got = {r.object_id: r for r in records.collect()}
    assert set(got) == {"a", "7"} and (got["a"].title, got["a"].techniques, got["a"].traits, got["a"].embedding_centroid, got["a"].dominant_colour) == ("first", ["t"], {"f": ["x"]}, [1.0, 2.5], None)
    assert got["7"].dominant_colour == '{"name":"red"}' and got["7"].techniques == []
    assert {r.reason: r.n for r in left.collect()} == {"blank": 2, "broken": 1, "no_object": 2, "no_id": 2, "no_vector": 3, "repeated": 1}


def test_the_first_record_of_a_file_that_many_tasks_read(spark, tmp_path):
    lines = [json.dumps({"object_id": str(i % 500), "embedding_centroid": [i], "title": "x" * 200}) for i in range(20_000)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        records, left = S.read_corpus_jsonl(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() >= 1 and sorted((int(r.object_id), r.embedding_centroid) for r in records.collect()) == [(i, [float(i)]) for i in range(500)]
        assert [tuple(r) for r in left.collect()] == [("repeated", 19_500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
