"""State changes as batch jobs: requests and decisions in, new rows and coded reasons out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import norm
from tessera.operators.games import HELD, rank_board
from tessera.shared import cut

#: Entries of a maker in a season; letters of a legend; confidence that verifies a claim.
MAX_ENTRIES, LEGEND_MIN, VERIFIED = 5, 40, 70


def _first(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in rules], F.lit(None).cast("string"))


def _folded(requests: DataFrame, already: DataFrame, most: int) -> DataFrame:
    """requests with `held`, `legends` and `before`: what stood of its maker and season when each request came, `before` those taken of the
    requests with smaller ids.

    requests: id, season_id, artist_uid, object, legendary, sound (whether it may be a legendary). A request is taken if fewer than
    `most` stand, its object wasn't taken before, and, for a legendary, if it is sound and none stands. Each round finds the next one taken
    of every maker and season at once, so there are `most` rounds at most and no task holds all of a maker's requests.
    """
    keys = ["season_id", "artist_uid"]
    own = cut(requests.withColumns({"artist_uid": F.coalesce("artist_uid", F.lit("")), "legendary": F.coalesce("legendary", F.lit(False)), "sound": F.coalesce("sound", F.lit(False))}))
    held = already.withColumn("artist_uid", F.coalesce("artist_uid", F.lit(""))).groupBy(*keys).agg(F.count("*").alias("held"), F.count_if("legendary").alias("legends"))
    kinds = dict(own.dtypes)
    state = own.select(*keys).distinct().join(held, keys, "left").fillna(0, ["held", "legends"])
    state = cut(state.withColumn("taken", F.array().cast(f"array<struct<id: {kinds['id']}, object: {kinds['object']}, legendary: boolean>>")))
    for _ in range(most):
        both = own.join(state, keys)
        later = F.coalesce(F.col("id") > F.array_max(F.transform("taken", lambda t: t["id"])), F.lit(True))
        open_ = (F.col("held") + F.size("taken") < most) & ~F.exists("taken", lambda t: t["object"] == F.col("object"))
        legend = ~F.col("legendary") | (F.col("sound") & (F.col("legends") == 0) & ~F.exists("taken", lambda t: t["legendary"]))
        after = both.where(later & open_ & legend).groupBy(*keys).agg(F.min(F.struct("id", "object", "legendary")).alias("x"))
        grown = state.join(after, keys, "left").withColumn("taken", F.when(F.col("x").isNotNull(), F.array_append("taken", F.col("x"))).otherwise(F.col("taken")))
        grown = cut(grown)
        state = grown.drop("x")
        if grown.where("x IS NOT NULL").isEmpty():
            break
    return own.join(state, keys).withColumn("before", F.filter("taken", lambda t: t["id"] < F.col("id"))).drop("taken")


def within_limits(requests: DataFrame, already: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """requests (id, season_id, artist_uid, legendary) with over_entries and over_legendary, in order of id.

    already: season_id, artist_uid, legendary of entries that stand. Only requests that are taken count for those after them.
    """
    asked = requests.withColumns({"object": F.col("id"), "sound": F.lit(True)})
    out = _folded(asked, already, max_entries)
    legends = (F.col("legends") > 0) | F.exists("before", lambda t: t["legendary"])
    flags = out.select("id", (F.col("held") + F.size("before") >= max_entries).alias("over_entries"), (F.col("legendary") & legends).alias("over_legendary"))
    return requests.join(flags, "id")


def enter(requests: DataFrame, seasons: DataFrame, objects: DataFrame, entries: DataFrame) -> DataFrame:
    """id, reason for each request to enter a piece; null where it is taken.

    requests: id, season_id, object_row_id, artist_uid, edition_size, legendary, legend. seasons: season_id, status. objects:
    object_row_id, owner_uid, fingerprinted (public ones). entries: season_id, object_row_id, artist_uid, legendary, status; rejected
    ones keep their piece from being entered again, but don't count for the limits. Reasons in order: no_season, not_open, not_public,
    not_owner, already_entered, too_many, and for a legendary edition, no_fingerprint, no_legend, second_legendary. Requests are taken in
    order of id; one that is refused stands in nobody's way.
    """
    r = requests.join(seasons.select("season_id", F.col("status").alias("_season")), "season_id", "left")
    r = r.join(objects.select("object_row_id", F.col("owner_uid").alias("_owner"), F.coalesce("fingerprinted", F.lit(False)).alias("_print")), "object_row_id", "left")
    r = r.join(entries.select("season_id", "object_row_id", F.lit(True).alias("_entered")).distinct(), ["season_id", "object_row_id"], "left")
    edition = F.greatest(F.coalesce("edition_size", F.lit(1)), F.lit(1)) != 1
    short = F.length(F.trim(F.coalesce("legend", F.lit("")))) < LEGEND_MIN
    unsound = _first((edition, "edition"), (~F.col("_print"), "no_fingerprint"), (short, "no_legend"))
    rules = [(F.col("_season").isNull(), "no_season"), (F.col("_season") != "open", "not_open"), (F.col("_print").isNull(), "not_public"), (F.col("artist_uid").isNull() | ~F.col("_owner").eqNullSafe(F.col("artist_uid")), "not_owner"), (F.col("_entered").isNotNull(), "already_entered")]
    checked = cut(r.select("id", "season_id", "artist_uid", F.col("object_row_id").alias("object"), "legendary", unsound.alias("unsound"), _first(*rules).alias("reason")))
    stands = entries.where("coalesce(status, '') <> 'rejected'").select("season_id", "artist_uid", "legendary")
    folded = _folded(checked.where("reason IS NULL").withColumn("sound", F.col("unsound").isNull()), stands, MAX_ENTRIES)
    again = F.exists("before", lambda t: t["object"] == F.col("object"))
    second = (F.col("legends") > 0) | F.exists("before", lambda t: t["legendary"])
    late = F.when(again, "already_entered").when(F.col("held") + F.size("before") >= MAX_ENTRIES, "too_many").when(F.col("legendary"), F.coalesce("unsound", F.when(second, "second_legendary")))
    return checked.where("reason IS NOT NULL").select("id", "reason").unionByName(folded.select("id", late.alias("reason")))


def record_claims(requests: DataFrame, claims: DataFrame, public: DataFrame, held: tuple[str, ...] = HELD) -> DataFrame:
    """object_row_id, collector_uid, status, confidence, outcome: what stands after requests (in order of id) on top of claims.

    A confidence of 70 (of 0 to 100) verifies, less is pending. One claim for each object and person: a verified request upgrades a
    pending claim, any other repeat changes nothing. outcome: new, upgraded, kept. Pieces that aren't public can't be claimed.
    """
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    asked = requests.where("coalesce(collector_uid, '') <> ''").join(public.select("object_row_id").distinct(), "object_row_id", "left_semi").withColumn("score", score)
    keys = ["object_row_id", "collector_uid"]
    per = asked.groupBy(*keys).agg(F.min_by("score", "id").alias("first"), F.min_by("score", F.when(F.col("score") >= VERIFIED, F.col("id"))).alias("good"))
    old = claims.select(*keys, F.col("status").alias("old"), F.col("confidence").cast("double").alias("old_score"))
    both = old.join(per, keys, "full")
    stands = F.col("old").isin(*held)
    better = F.col("good").isNotNull() & ~F.coalesce(stands, F.lit(False))
    outcome = F.when(F.col("old").isNull(), "new").when(better, "upgraded").otherwise("kept")
    status = F.when(better, "verified").when(F.col("old").isNotNull(), F.col("old")).otherwise("pending")
    return both.select(*keys, status.alias("status"), F.when(better, F.col("good")).otherwise(F.coalesce("old_score", "first")).alias("confidence"), outcome.alias("outcome"))


def backfill_claims(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """claims whose season or entry is missing get those of the object's latest entry."""
    last = entries.groupBy("object_row_id").agg(F.max(F.struct("season_id", "id")).alias("_e"))
    both = claims.join(last, "object_row_id", "left")
    return both.withColumns({"season_id": F.coalesce("season_id", "_e.season_id"), "entry_id": F.coalesce("entry_id", "_e.id")}).select(*claims.columns)


def close_season(boards: DataFrame, season: int) -> DataFrame:
    """The final board of a season: id, rank, vote_count, favourite (the first one, if it has votes)."""
    own = boards.where(F.col("season_id") == season)
    return own.select("id", "rank", "vote_count", ((F.col("rank") == 1) & (F.col("vote_count") > 0)).alias("favourite"))


def award_badges(earned: DataFrame, held: DataFrame) -> DataFrame:
    """The badges earned that aren't held yet (uid, badge, season_id)."""
    return earned.join(held.select("uid", "badge", "season_id"), ["uid", "badge", "season_id"], "left_anti")


def prizes_won(prizes: DataFrame, who: str) -> DataFrame:
    """winner, prizes, first_places by maker or studio: prizes have kind (of winner), winner, rank."""
    own = prizes.where((F.col("kind") == who) & (F.trim("winner") != ""))
    return own.groupBy(norm(F.col("winner")).alias("winner")).agg(F.count("*").alias("prizes"), F.count_if(F.col("rank") == 1).alias("first_places"))


def promote(submissions: DataFrame, images: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, images, approvals) of the submissions that were approved; object ids come from the content hash."""
    yes = submissions.join(decisions.where("status = 'approved'").select("submission_id").distinct(), "submission_id", "left_semi")
    objects = yes.withColumn("object_row_id", F.left("content_hash", F.lit(16)))
    objects = objects.withColumn("_n", F.row_number().over(Window.partitionBy("object_row_id").orderBy("submission_id"))).where("_n = 1").drop("_n")
    pictures = images.join(objects.select("submission_id", "object_row_id"), "submission_id")
    return objects, pictures, objects.select(F.lit("objects").alias("tbl"), F.col("object_row_id").alias("row_id"), F.lit("approved").alias("status"))


def review(rows: DataFrame, decisions: DataFrame, stage: str) -> DataFrame:
    """rows (id, status) after decisions (id, approve) of the host or the admin; only rows in the right state move."""
    wanted, passed = {"host": ("pending_host", "host_approved"), "admin": ("host_approved", "approved")}[stage]
    own = decisions.groupBy("id").agg(F.bool_and("approve").alias("_approve"))
    both = rows.join(own, "id", "left")
    moves = (F.col("status") == wanted) & F.col("_approve").isNotNull()
    return both.withColumn("moved", F.coalesce(moves, F.lit(False))).withColumn("status", F.when(F.col("moved"), F.when(F.col("_approve"), passed).otherwise("rejected")).otherwise(F.col("status"))).drop("_approve")


def decide(decisions: DataFrame, queues: dict[str, DataFrame]) -> DataFrame:
    """queue, id, outcome of decisions (queue, id, approve): approved or rejected, not_waiting, or no_queue.

    queues: the waiting rows (id) by the queue's name.
    """
    waiting = reduce(DataFrame.unionByName, [df.select(F.lit(q).alias("queue"), F.col("id").cast("string").alias("id"), F.lit(True).alias("_waits")) for q, df in queues.items()]).distinct()
    both = decisions.withColumn("id", F.col("id").cast("string")).join(waiting, ["queue", "id"], "left")
    outcome = F.when(~F.col("queue").isin(*queues), "no_queue").when(F.col("_waits").isNull(), "not_waiting").when(F.col("approve"), "approved").otherwise("rejected")
    return both.select("queue", "id", outcome.alias("outcome"))


def queue_counts(queues: dict[str, DataFrame]) -> DataFrame:
    """queue, n of what waits, and the total."""
    each = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(q).alias("queue"), "n") for q, df in queues.items()])
    return each.unionByName(each.agg(F.lit("total").alias("queue"), F.sum("n").alias("n")))


def collections(claims: DataFrame, entries: DataFrame, sharers: DataFrame | None = None) -> DataFrame:
    """uid, object_row_id, title, season_id of what each person holds; with sharers (uid, share_id) only theirs, by share_id."""
    own = claims.where(F.col("status").isin(*HELD)).select(F.col("collector_uid").alias("uid"), "object_row_id", "entry_id")
    out = own.join(entries.select(F.col("id").alias("entry_id"), "title", "season_id"), "entry_id", "left").drop("entry_id")
    return out if sharers is None else out.join(sharers, "uid").drop("uid")


def inbox(claims: DataFrame, objects: DataFrame) -> DataFrame:
    """owner_uid, place, id, status: the claims on each publisher's pieces, pending first, then the newest."""
    both = claims.join(objects.select("object_row_id", "owner_uid"), "object_row_id")
    order = Window.partitionBy("owner_uid").orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("created_at"), F.desc("id"))
    return both.withColumn("place", F.row_number().over(order)).select("owner_uid", "place", "id", "status")


def logins(events: DataFrame, admins: DataFrame) -> DataFrame:
    """email, n, first, last, is_admin from login events (email, ts, admin) and a list of admins (email)."""
    own = events.withColumn("email", F.lower(F.trim("email"))).where("email <> ''")
    per = own.groupBy("email").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or(F.coalesce("admin", F.lit(False))).alias("_own"))
    return per.join(admins.select(F.lower(F.trim("email")).alias("email"), F.lit(True).alias("_listed")).distinct(), "email", "left").select("email", "n", "first", "last", (F.col("_own") | F.col("_listed").isNotNull()).alias("is_admin"))


def seasons_list(seasons: DataFrame, entries: DataFrame) -> DataFrame:
    """seasons with entries, makers and is_current: the open season that began last."""
    n = entries.groupBy("season_id").agg(F.count("*").alias("entries"), F.countDistinct("artist_uid").alias("makers"))
    current = seasons.where("status = 'open'").agg(F.max_by("season_id", F.struct("starts", "season_id")).alias("_current"))
    out = seasons.join(n, "season_id", "left").fillna(0, ["entries", "makers"]).crossJoin(F.broadcast(current))
    return out.withColumn("is_current", F.coalesce(F.col("season_id") == F.col("_current"), F.lit(False))).drop("_current")


def event_directory(events: DataFrame, registrations: DataFrame, on: str, listed_only: bool = True) -> DataFrame:
    """events (id, status, opens, closes, listed, starts) with open and counts of registrations by status."""
    n = registrations.groupBy(F.col("event_id").alias("id")).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending_host", "host_approved", "approved", "rejected")])
    shown = events.where("listed") if listed_only else events
    out = shown.withColumn("open", open_on(on)).join(n, "id", "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_")])


def open_on(on: str) -> Column:
    """Whether registration is open on a day; a missing bound doesn't bound."""
    day = F.lit(on).cast("date")
    return (F.col("status") == "open") & F.coalesce(F.col("opens") <= day, F.lit(True)) & F.coalesce(F.col("closes") >= day, F.lit(True))


def session_decisions(log: DataFrame) -> DataFrame:
    """session, decision (the last one), history (all in order) from a log of session, decision, ts."""
    return log.groupBy("session").agg(F.max_by("decision", "ts").alias("decision"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "decision"))), lambda x: x["decision"]).alias("history"))


def delete_where(df: DataFrame, cond: Column, key: str, dependants: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """df (under "rows") and its dependants (table, their key) without the rows for which cond holds. A null keeps a row."""
    gone = F.coalesce(cond, F.lit(False))
    ids = df.where(gone).select(key)
    kept = {n: d.join(ids.withColumnRenamed(key, theirs), theirs, "left_anti") for n, (d, theirs) in dependants.items()}
    return {"rows": df.where(~gone)} | kept


def approve_existing(tables: dict[str, DataFrame], approvals: DataFrame) -> DataFrame:
    """approvals with every row approved that has no decision yet."""
    ids = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("tbl"), F.col("_row_id").alias("row_id")) for t, df in tables.items()])
    return approvals.unionByName(ids.join(approvals.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti").withColumn("status", F.lit("approved")))


def next_step(registered: Column, published: Column, waiting: Column, confirmed: Column, entered: Column) -> Column:
    """What an object's owner does next."""
    return F.when(~registered, "register").when(~published, F.when(waiting, "review").otherwise("publish")).when(~confirmed, "confirm").when(~entered, "enter").otherwise("done")


def object_cards(objects: DataFrame, images: DataFrame, events: DataFrame, approvals: DataFrame) -> DataFrame:
    """objects (object_row_id, user_id) with images, events and state (published, in_review, private)."""
    count = lambda df, name: df.groupBy("object_row_id").agg(F.count("*").alias(name))
    state = approvals.select(F.col("row_id").alias("object_row_id"), F.col("status").alias("_status"))
    out = objects.join(count(images, "images"), "object_row_id", "left").join(count(events, "events"), "object_row_id", "left").join(state, "object_row_id", "left").fillna(0, ["images", "events"])
    return out.withColumn("state", F.when(F.col("_status") == "approved", "published").when(F.col("_status") == "pending", "in_review").otherwise("private")).drop("_status")


def owner_dashboard(cards: DataFrame, claims: DataFrame) -> DataFrame:
    """user_id, pieces, published, in_review, claims_waiting."""
    waiting = claims.where("status = 'pending'").groupBy("object_row_id").agg(F.count("*").alias("w"))
    return cards.join(waiting, "object_row_id", "left").groupBy("user_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("state") == "published").alias("published"), F.count_if(F.col("state") == "in_review").alias("in_review"), F.coalesce(F.sum("w"), F.lit(0)).alias("claims_waiting"))


def manifests(objects: DataFrame, events: DataFrame) -> DataFrame:
    """object_row_id, manifest (JSON with title, maker and provenance events in order), content_hash of it."""
    own = events.groupBy("object_row_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("provenance"))
    both = objects.join(own, "object_row_id", "left").withColumn("manifest", F.to_json(F.struct("title", "maker", F.coalesce("provenance", F.array().cast("array<struct<at:string,kind:string>>")).alias("provenance"))))
    return both.select("object_row_id", "manifest", F.sha2("manifest", 256).alias("content_hash"))


def recents(objects: DataFrame, tbl: str, approvals: DataFrame, n: int = 24) -> DataFrame:
    """The n newest approved objects."""
    ok = approvals.where((F.col("tbl") == tbl) & (F.col("status") == "approved")).select(F.col("row_id").alias("_row_id"))
    return objects.join(ok, "_row_id", "left_semi").orderBy(F.desc("created_at"), F.desc("_row_id")).limit(n)


def maker_leaderboards(makers: DataFrame, boards: dict[str, str], top: int = 10) -> DataFrame:
    """board, rank, maker, value: the first of each board (name: metric) among makers with something to show."""
    each = [rank_board(makers.where(F.col(m) > 0).select(F.lit(b).alias("board"), "maker", F.col(m).cast("double").alias("value")), ["board"], [F.desc("value"), F.asc("maker")]).where(F.col("rank") <= top) for b, m in boards.items()]
    return reduce(DataFrame.unionByName, each)
