"""Operators on small fixtures with blanks, ties, odd values; plain Python where no SQL can say it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import games, matching, profile, resolution, tables, workflow
from tessera.plans.catalogue import QUERIES


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("data", [[], [3.0], [1.0, 2.0], [5.0] * 40, [float(i % 17) for i in range(500)], [1e9, *map(float, range(100))]])
def test_quantiles_are_exact(spark, data):
    df = spark.createDataFrame([(x,) for x in [*data, None, float("nan")]], "x double")
    got = profile.quantiles(df, "x", [0.02, 0.5, 0.98]).first()
    if not data:
        assert list(got) == [None] * 3
    else:
        assert np.allclose(list(got), np.quantile(data, [0.02, 0.5, 0.98]))


def test_columns_are_profiled_by_numbers_and_values(spark):
    rows = [("1", "a", "x1", None), ("1.0", "b", "x2", ""), ("01", "a", "x3", " "), ("2", "b", "x4", None), (" 3", " ", "x5", None), ("4", "b", "x6", None)]
    df = spark.createDataFrame(rows, "size string, colour string, artist_id string, blank string")
    got = {r.column: (r.n_filled, r.n_numeric, r.n_values, r.n_numbers, r.kind) for r in profile.profile_columns(df).collect()}
    assert got == {"size": (6, 6, 6, 4, "numeric"), "colour": (5, 0, 2, 0, "categorical"), "blank": (0, 0, 0, 0, "empty")}


def test_years_are_counted_by_decade(spark):
    df = spark.createDataFrame([(x,) for x in ["1955", "1951", "1849", "2031", "x", "", None, "1960"]], "born string")
    assert sorted((r.bin, r.n) for r in profile.histogram(df, "born", 2024).collect()) == [(1950, 2), (1960, 1)]


def test_names_and_blanks(spark):
    raw = [" Ana  Li ", "test", "TBD", "n/a", "a@b.c", "1234", "É", "éa", None, "-", "x" * 121]
    got = spark.createDataFrame([(x,) for x in raw], "c string").select(T.looks_like_name(F.col("c")))
    assert [r[0] for r in got.collect()] == [True, False, False, False, False, False, False, True, False, False, False]


def test_row_ids_of_blank_keys_hash_the_row(spark):
    import hashlib

    df = spark.createDataFrame([(" ", None, "v")], "k string, j string, a string")
    got = df.select(T.row_id("t", [F.col("k"), F.col("j")], {c: F.col(c) for c in df.columns})).first()[0]
    assert got == hashlib.sha1(b"t|a=v|j=|k= ").hexdigest()[:16]


def test_slugs():
    assert tables.slug_columns(["Artist Name", "artist-name", "2nd place", "", "é", "x" * 60]) == ["artist_name", "artist_name_2", "c_2nd_place", "col", "col_2", "x" * 48]


def test_imports_go_row_by_row(spark):
    base = spark.createDataFrame([("1", "a", 1.0, "n"), ("2", "b", 2.0, "n"), ("3", "c", 3.0, "n")], "_row_id string, name string, size double, _note string")
    sheet = spark.createDataFrame([
        (0, "1", " ", "7", "z"), (1, None, "d", "4", "z"), (2, "9", "", None, "z"), (3, "9", "e", "x", "z"), (4, "9", "", "", "z"), (5, "2", "p", "1", "z"), (6, "2", "q", "2", "z"), (7, " ", "d", "4", "z"), (8, None, " ", "", "z"), (9, "8", "", "", "z"),
    ], "n long, _row_id string, name string, size string, _note string")
    out, report, approvals = tables.import_csv(base, sheet, order="n")
    rows = {r._row_id: (r.name, r.size, r._note) for r in out.collect()}
    loose = [i for i in rows if len(i) == 16]
    assert {i: v for i, v in rows.items() if i not in loose} == {"1": (" ", 7.0, "n"), "2": ("q", 2.0, "n"), "3": ("c", 3.0, "n"), "9": ("", None, None)}
    assert [rows[i] for i in loose] == [("d", 4.0, None)] * 2 and tuple(report.first()) == (4, 3, 3)
    assert {r.row_id for r in approvals.collect()} == {"1", "2", "9", *loose}
    with pytest.raises(ValueError):
        tables.import_csv(base, sheet.select("_row_id", "_note"))


def test_calendars_escape_and_fold(spark):
    from datetime import date

    titles = ["a\\b; c,d", "x\ny\r\nz", "é" * 60, "w" * 64, "w" * 65, "w" * 66, None, "漢" * 100, "a" + "🙂" * 40]
    df = spark.createDataFrame([(i, t, date(2024, 2, 29), None, "http://x/" + "q" * 150) for i, t in enumerate(titles)] + [(99, "no date", None, None, "")], "id long, title string, starts date, ends date, url string")
    got = {r.id: r.entry for r in tables.ics_events(df, stamp="20240101T000000Z").collect()}
    assert set(got) == set(range(len(titles))) and "SUMMARY:a\\\\b\\; c\\,d\r\n" in got[0] and "SUMMARY:x\\ny\\nz\r\n" in got[1] and "DTEND;VALUE=DATE:20240301\r\n" in got[0] and "DTSTAMP:20240101T000000Z" in got[0]
    for i, t in enumerate(titles):
        assert all(len(line.encode()) <= 73 for line in got[i].split("\r\n"))
        assert f"SUMMARY:{(t or '')}" in got[i].replace("\r\n ", "") or i < 2
    assert "SUMMARY:" + "w" * 65 + "\r\n" in got[4] and "SUMMARY:" + "w" * 64 + "\r\n ww\r\n" in got[5]
    lines = [r.line for r in tables.ics_calendar(tables.ics_events(df), "Calls").orderBy("n").collect()]
    assert lines[0].startswith("BEGIN:VCALENDAR\r\nVERSION:2.0") and lines[-1] == "END:VCALENDAR" and len(lines) == len(titles) + 2


def test_csv_and_snapshots_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nthere'), ("2", None)], "_row_id string, note string")
    tables.export_csv(df, f"{tmp_path}/csv")
    assert sorted(values(tables.ingest(spark, f"{tmp_path}/csv").select("row_id", "note"))) == [("1", 'say "hi",\nthere'), ("2", None)]
    for stamp in ("20240101", "20240102"):
        tables.snapshot(df, f"{tmp_path}/snaps", stamp)
    assert values(tables.snapshots(spark, f"{tmp_path}/snaps")) == [("20240102", 2), ("20240101", 2)]
    assert tables.restore(spark, f"{tmp_path}/snaps", "20240101").count() == 2


def test_unknown_columns_are_refused(spark):
    base = spark.createDataFrame([("1", "a")], "_row_id string, name string")
    with pytest.raises(ValueError, match="nowhere"):
        tables.append_submissions(base, base.withColumn("nowhere", F.lit(1)))


def test_near_names_join_clusters(spark):
    rows = [("a", "person", "Maria Hernandez Lopez", ""), ("b", "person", "Maria J. Hernandez Lopez", ""), ("c", "person", "Lopez, Maria Hernandez", ""), ("d", "person", "Bob Stone", ""), ("e", "studio", "Hot Shop", "Rome"), ("f", "studio", "HOT  shop", "Oslo"), ("g", "studio", "Cold Shop", "Rome"), ("h", "studio", "Cold shop", None), ("i", "person", None, None)]
    items = spark.createDataFrame(rows, "key string, kind string, label string, city string")
    got = {r.key: r.cluster for r in resolution.cluster_items(items).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "g", "i": "i"}


def test_reconcile_scores(spark):
    items = spark.createDataFrame([("k1", "Dale Chihuly", ["D. Chihuly"]), ("k2", "Dale Chihuli", None), ("k3", "Chihuly Studio Dale Garden", None), ("k4", "Dale  CHIHULY", None), ("k5", "Other", ["Lino"])], "key string, label string, aliases array<string>")
    queries = spark.createDataFrame([("dale chihuly",), ("Lino",), ("",), (None,)], "query string")
    got = {(r.query, r.key): (r.score, r.match) for r in resolution.reconcile(queries, items).collect()}
    assert got[("dale chihuly", "k1")] == (100.0, False) and got[("dale chihuly", "k4")] == (100.0, False)
    assert got[("dale chihuly", "k2")][0] == 91.7 and got[("dale chihuly", "k3")][0] == 90.0 and got[("Lino", "k5")] == (99.0, True)


def plain_pairs(sim, q_pose, r_pose):
    turns = range(0, 360, 30) if sum(p is not None for p in q_pose) >= 3 and sum(p is not None for p in r_pose) >= 3 else [None]
    results = []
    for turn in turns:
        left = [(i, j) for i in range(len(sim)) for j in range(len(sim[0])) if round(sim[i][j], 6) >= 0.5]
        pairs, off = {}, 0.0
        while left:
            i, j = max(left, key=lambda p: (round(sim[p[0]][p[1]], 6), -p[0], -p[1]))
            left.remove((i, j))
            if turn is not None and q_pose[i] and r_pose[j]:
                d = abs((q_pose[i][0] - r_pose[j][0] - turn + 180) % 360 - 180)
                if d > 45 or abs(q_pose[i][1] - r_pose[j][1]) > 25:
                    continue
                off += d
            pairs[i] = j
            left = [(a, b) for a, b in left if a != i and b != j]
        results.append(((round(sum(round(sim[i][j], 6) for i, j in pairs.items()), 6), len(pairs), -round(off, 6)), pairs))
    return max(results, key=lambda r: r[0])[1]


def test_views_are_paired_one_to_one():
    rng = np.random.default_rng(2)
    for n in range(60):
        sim = rng.uniform(0.3, 1, (rng.integers(1, 8), rng.integers(1, 8))).round(1 if n % 2 else 8)
        poses = [[(float(rng.uniform(0, 360)), float(rng.uniform(0, 60))) if rng.random() < 0.8 else None for _ in range(k)] for k in sim.shape]
        assert matching.greedy(sim, *poses)[0] == plain_pairs(sim.tolist(), *poses)


def test_views_without_descriptor_match_nothing(spark):
    kind = "owner string, seq int, cell int, descriptor array<double>"
    q = spark.createDataFrame([("q", 1, 1, [1.0, 2.0, 4.0]), ("q", 2, 1, None), ("q", 3, 1, [1.0, 1.0, 1.0])], kind)
    r = spark.createDataFrame([("r", 1, 1, [2.0, 4.0, 8.0]), ("r", 2, 2, [1.0]), ("s", 1, 1, [3.0, 2.0, 1.0])], kind)
    seen = matching.view_pairs(matching.candidate_pairs(q, r), q, r)
    v1 = {x.r: (x.confidence, x.views_matched, x.strong) for x in matching.aggregate_match(matching.match_frames(seen)).collect()}
    v2 = {x.r: x.confidence for x in matching.aggregate_match(matching.assign_frames(seen), "v2").collect()}
    assert v1 == {"r": (50, 1, 1), "s": (0, 0, 0)} and v2 == {"r": 50, "s": 0}


def plain_votes(toggles, cap):
    standing, out = {}, {}
    for id_, voter, entry in sorted(toggles):
        own = standing.setdefault(voter, set())
        if entry in own:
            own.remove(entry)
            out[id_] = "removed"
        elif len(own) < cap:
            own.add(entry)
            out[id_] = "cast"
        else:
            out[id_] = "over_cap"
    return out, {(v, e) for v, own in standing.items() for e in own}


def test_vote_streams_and_folds_equal_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(user_id % 40 AS string)", "cast(floor(value) AS long)").collect()
    want, standing = plain_votes([tuple(r) for r in rows], 5)
    assert {r.id: r.change for r in QUERIES["stream_vote_state"](spark, sf).collect()} == want and len(set(want.values())) == 3
    toggles = spark.createDataFrame([(r[0], 1, r[1], r[2], r[0]) for r in rows], "id long, season_id int, voter_uid string, entry_id long, created_at long")
    assert {(r.voter_uid, r.entry_id) for r in games.fold_votes(toggles, 5).collect()} == standing


def test_reviews_move_only_what_waits(spark):
    rows = spark.createDataFrame([(1, "pending_host"), (2, "approved"), (3, None)], "id int, status string")
    said = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True)], "id int, approve boolean")
    assert sorted(values(workflow.review(rows, said, "host").select("id", "status", "moved"))) == [(1, "host_approved", True), (2, "approved", False), (3, None, False)]
