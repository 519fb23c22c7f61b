"""Streams whose state lasts over calls; a busy voter whose rows come in many chunks; the session's settings stay."""

import random
from datetime import datetime, timedelta

from tessera.streaming import usage as S

DAY = datetime(2024, 1, 1)


def wrote(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_thirty_thousand_toggles_of_one_voter(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, 1, "busy" if i % 10 else "other", rng.randrange(9)) for i in range(33_000)]
    rng.shuffle(rows)
    wrote(spark, tmp_path, "in", rows, "id long, season_id long, voter_uid string, entry_id long")
    stream = spark.readStream.schema("id long, season_id long, voter_uid string, entry_id long").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with S.rocksdb(spark):
        got = {r.id: r.change for r in S.landed(S.vote_state(stream, 5), "votes").collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    standing, want = {"busy": set(), "other": set()}, {}
    for i, _, who, entry in sorted(rows):
        votes = standing[who]
        want[i] = "removed" if entry in votes else "cast" if len(votes) < 5 else "over_cap"
        (votes.discard if entry in votes else votes.add if len(votes) < 5 else lambda e: None)(entry)
    assert got == want and set(want.values()) == {"removed", "cast", "over_cap"}


def test_two_calls_over_two_arrivals_equal_one(spark, tmp_path):
    rng = random.Random(2)
    moves = [(rng.randrange(40), i, rng.choice(["host_yes", "admin_yes", "no", "admin_yes"])) for i in range(300)]
    kind = "id long, seq long, move string"
    source = lambda folder: spark.readStream.schema(kind).parquet(f"{folder}/*")
    wrote(spark, tmp_path / "once", "all", moves, kind)
    want_state = sorted(map(tuple, S.registration_state(source(tmp_path / "once")).collect()))
    want_last = sorted(map(tuple, S.latest_per_source(source(tmp_path / "once"), "id", "seq").collect()))
    for k, part in enumerate((moves[:100], moves[100:120], moves[120:])):
        wrote(spark, tmp_path / "parts", f"p{k}", part, kind)
        state = S.registration_state(source(tmp_path / "parts"), f"{tmp_path}/state")
        last = S.latest_per_source(source(tmp_path / "parts"), "id", "seq", f"{tmp_path}/last")
    assert sorted(map(tuple, state.collect())) == want_state and sorted(map(tuple, last.collect())) == want_last
    again = S.registration_state(source(tmp_path / "parts"), f"{tmp_path}/state")  # nothing new has arrived
    assert sorted(map(tuple, again.collect())) == want_state
    assert len(S._versions(spark, f"{tmp_path}/state/rows")) <= 2


def test_an_approval_feed_goes_on(spark, tmp_path):
    base = spark.createDataFrame([(i,) for i in range(6)], "k long")
    kind = "k long, status string, seq long"
    source = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
    seen = []
    for n, rows in enumerate(([(1, "approved", 1), (2, "approved", 2)], [(2, "rejected", 3), (3, "approved", 4)], [(2, "approved", 5), (1, "rejected", 0)])):
        wrote(spark, tmp_path / "in", f"b{n}", rows, kind)
        seen.append(sorted(r.k for r in S.publish_feed(source(), base, "k", f"{tmp_path}/feed").collect()))
    assert seen == [[1, 2], [1, 3], [1, 2, 3]]


def test_old_days_drop_out_over_calls(spark, tmp_path):
    kind = "ts timestamp, x long"
    event = lambda day, hour: (DAY + timedelta(days=day, hours=hour), day)
    source = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
    arrivals = [[event(d, h) for d in range(4) for h in (1, 2)], [event(3, 5), event(5, 1)], [event(9, 12), event(9, 13)], [event(1, 1), event(9, 14), event(8, 20)]]
    seen = []
    for n, rows in enumerate(arrivals):
        wrote(spark, tmp_path / "in", f"a{n}", rows, kind)
        got = S.kept_days(source(), 3, f"{tmp_path}/days").collect()
        seen.append({(r.day - DAY.date()).days: r.n for r in got})
    assert seen[0] == {0: 2, 1: 2, 2: 2, 3: 2} and seen[1][3] == 3 and seen[1][5] == 1
    assert seen[2] == {5: 1, 9: 2} and seen[3] == {5: 1, 8: 1, 9: 3}
