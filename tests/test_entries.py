"""Requests to enter pieces, one after the other, against a plain loop; refused ones stand in nobody's way."""

import random

from tessera.operators import workflow as W


def plain(requests, seasons, objects, entries):
    stands = [dict(e) for e in entries]
    out = {}
    for r in sorted(requests, key=lambda r: r["id"]):
        mine = [e for e in stands if e["season_id"] == r["season_id"] and e["artist_uid"] == r["artist_uid"] and e["status"] != "rejected"]
        why, piece = None, objects.get(r["object_row_id"])
        if r["season_id"] not in seasons:
            why = "no_season"
        elif seasons[r["season_id"]] != "open":
            why = "not_open"
        elif piece is None:
            why = "not_public"
        elif piece[0] != r["artist_uid"] or r["artist_uid"] is None:
            why = "not_owner"
        elif any(e["season_id"] == r["season_id"] and e["object_row_id"] == r["object_row_id"] for e in stands):
            why = "already_entered"
        elif len(mine) >= 5:
            why = "too_many"
        elif r["legendary"]:
            why = "edition" if max(1, r["edition_size"] or 1) != 1 else "no_fingerprint" if not piece[1] else "no_legend" if len((r["legend"] or "").strip()) < 40 else "second_legendary" if any(e["legendary"] for e in mine) else None
        if why is None:
            stands.append({**{k: r[k] for k in ("season_id", "object_row_id", "artist_uid")}, "legendary": bool(r["legendary"]), "status": "pending"})
        out[r["id"]] = why
    return out


KIND = "id long, season_id int, object_row_id string, artist_uid string, edition_size int, legendary boolean, legend string"


def compared(spark, requests, seasons, objects, entries):
    df = spark.createDataFrame
    got = W.enter(
        df([tuple(r.values()) for r in requests], KIND), df(list(seasons.items()), "season_id int, status string"), df([(k, *v) for k, v in objects.items()], "object_row_id string, owner_uid string, fingerprinted boolean"),
        df([tuple(e.values()) for e in entries], "season_id int, object_row_id string, artist_uid string, legendary boolean, status string"),
    )
    rows = got.collect()
    assert len(rows) == len(requests)
    assert {r.id: r.reason for r in rows} == plain(requests, seasons, objects, entries)
    return {r.id: r.reason for r in rows}


def request(id, piece, artist, edition=1, legendary=False, legend="x" * 40, season=1):
    return dict(id=id, season_id=season, object_row_id=piece, artist_uid=artist, edition_size=edition, legendary=legendary, legend=legend)


def test_refused_requests_dont_block(spark):
    objects = {f"o{i}": ("ann", i % 2 == 0) for i in range(12)} | {"b": ("bob", True)}
    requests = [request(1, "o0", "bob"), request(2, "o0", "ann"), request(3, "o0", "ann"), *(request(4 + i, f"o{2 + i}", "ann", legendary=True) for i in range(6)), request(20, "o9", "ann"), request(21, "o10", "ann"), request(22, "o11", "ann"), request(23, "o1", "ann", legendary=True, edition=2), request(24, "b", None), request(25, "b", "bob", legend=None, legendary=True), request(26, "b", "bob", edition=None)]
    got = compared(spark, requests, {1: "open"}, objects, [])
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == ["not_owner", None, "already_entered", None, "no_fingerprint", "second_legendary"] and got[22] is None and got[23] == "too_many" and got[26] is None


def test_random_requests_equal_a_plain_loop(spark):
    rng = random.Random(8)
    objects = {f"o{i}": (rng.choice(["a", "b", "c"]), rng.random() < 0.7) for i in range(60)}
    requests = [request(i, f"o{rng.randrange(64)}", rng.choice(["a", "a", "b", "c", None]), rng.choice([1, 1, 0, None, 3]), rng.choice([True, False, False, None]), rng.choice(["x" * 40, " " * 50, None, "y" * 60]), rng.choice([1, 1, 1, 2, 3])) for i in range(600)]
    entries = [dict(season_id=1, object_row_id=f"o{i}", artist_uid=objects[f"o{i}"][0], legendary=i % 2 == 0, status=rng.choice(["rejected", "approved", "pending"])) for i in range(4)]
    assert len(set(compared(spark, requests, {1: "open", 2: "closed"}, objects, entries).values())) >= 8


def test_limits_count_what_was_taken(spark):
    rows = [(i, 1, "a", i < 4) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, season_id int, artist_uid string, legendary boolean")
    got = {r.id: (r.over_entries, r.over_legendary) for r in W.within_limits(df, df.limit(0)).collect()}
    assert got == {0: (False, False), **{i: (False, True) for i in (1, 2, 3)}, **{i: (False, False) for i in (4, 5, 6, 7)}}
