"""Competitions: boards, awards, prizes, badges, careers and scores.

entries: id, season_id, object_row_id, artist_uid, artist_name, studio, title, edition_size, created_at, solo, legendary,
fingerprinted, height_mm; all approved. votes: entry_id, voter_uid. claims: season_id, entry_id, object_row_id, collector_uid,
collector_name, status, created_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, norm, rarity, rarity_points
from tessera.shared import cut

HELD = ("verified", "approved")


def counted(entries: DataFrame, votes: DataFrame, claims: DataFrame) -> DataFrame:
    """entries with vote_count, claim_count (held claims of the object), rarity and points."""
    v = votes.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("vote_count"))
    c = claims.where(F.col("status").isin(*HELD)).groupBy("object_row_id").agg(F.count("*").alias("claim_count"))
    out = entries.join(v, "id", "left").join(c, "object_row_id", "left").fillna(0, ["vote_count", "claim_count"])
    out = out.withColumn("rarity", rarity(F.col("legendary"), F.col("claim_count") > 0, F.col("fingerprinted"), F.col("edition_size")))
    return out.withColumn("points", rarity_points(F.col("rarity")))


def rank_board(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """Adds rank: 1, 2, … without gaps, ties broken by the whole order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def rank_all(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank over all rows: they are sorted in ranges, ranked in each range and offset by the rows before it."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("_part", part).join(F.broadcast(before.select("_part", "_before")), "_part")
    return ranked.withColumn("rank", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_before")


def peoples_choice(counted_: DataFrame) -> DataFrame:
    return rank_board(counted_, ["season_id"], [F.desc("vote_count"), F.asc_nulls_first("created_at"), F.asc("id")])


def most_collected(counted_: DataFrame) -> DataFrame:
    return rank_board(counted_, ["season_id"], [F.desc("claim_count"), F.desc("vote_count"), F.asc_nulls_first("created_at"), F.asc("id")])


def crowd_favourite(board: DataFrame) -> DataFrame:
    return board.where("rank = 1 AND vote_count > 0")


def best_rank(board: DataFrame) -> DataFrame:
    """season_id, artist_uid, best_rank over entries that have votes."""
    return board.where("vote_count > 0").groupBy("season_id", "artist_uid").agg(F.min("rank").alias("best_rank"))


def _maker() -> Column:
    return F.coalesce(F.nullif(F.col("artist_uid"), F.lit("")), F.concat(F.lit("name:"), F.coalesce(F.col("artist_name"), F.col("id").cast("string"))))


def _spelling(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """For each key the most used spelling of col; on ties the one seen first by (created_at, id)."""
    seen = df.where(F.col(col) != "").groupBy(*keys, col).agg(F.count("*").alias("_n"), F.min(F.struct("created_at", "id")).alias("_first"))
    return seen.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first"))).where("_at = 1").select(*keys, col)


def studio_board(counted_: DataFrame) -> DataFrame:
    """A row for each studio of a season, whatever its case and spacing; entries without one come last as Independent."""
    e = counted_.withColumn("studio", collapse(F.coalesce("studio", F.lit("")))).withColumn("studio_key", F.when(F.col("studio") == "", "independent").otherwise(F.lower("studio")))
    sums = e.groupBy("season_id", "studio_key").agg(F.countDistinct(_maker()).alias("makers"), F.count("*").alias("entries"), F.sum("claim_count").alias("claims"), F.sum("vote_count").alias("votes"), F.count_if("fingerprinted").alias("registered"), F.every(F.col("studio") == "").alias("independent"))
    out = sums.join(_spelling(e, ["season_id", "studio_key"], "studio"), ["season_id", "studio_key"], "left").fillna("Independent", ["studio"])
    return rank_board(out, ["season_id"], [F.asc("independent"), F.desc("makers"), F.desc("entries"), F.desc("claims"), F.desc("votes"), F.lower("studio")])


def maker_board(counted_: DataFrame) -> DataFrame:
    e = counted_.withColumn("studio", collapse(F.coalesce("studio", F.lit("")))).withColumn("maker", _maker())
    sums = e.groupBy("season_id", "maker").agg(F.min_by("artist_name", F.struct("created_at", "id")).alias("artist_name"), F.count("*").alias("entries"), F.count_if("fingerprinted").alias("registered"), F.sum("claim_count").alias("claims"), F.sum("vote_count").alias("votes"))
    out = sums.join(_spelling(e, ["season_id", "maker"], "studio"), ["season_id", "maker"], "left").fillna({"studio": "", "artist_name": "A maker"})
    return rank_board(out, ["season_id"], [F.desc("registered"), F.desc("entries"), F.desc("claims"), F.desc("votes"), F.lower("artist_name"), F.asc("maker")])


def points_board(counted_: DataFrame, claims: DataFrame) -> DataFrame:
    """What each collector holds of a season, by rarity points."""
    held = claims.where(F.col("status").isin(*HELD) & F.col("entry_id").isNotNull()).select("season_id", "entry_id", "collector_uid", "collector_name")
    e = counted_.select("season_id", F.col("id").alias("entry_id"), "points", "rarity", norm(F.coalesce("studio", F.lit(""))).alias("_studio"))
    out = held.join(e, ["season_id", "entry_id"]).groupBy("season_id", "collector_uid").agg(F.coalesce(F.max("collector_name"), F.lit("A collector")).alias("collector_name"), F.sum("points").alias("points"), F.count("*").alias("pieces"), F.count_if(F.col("rarity") == "legendary").alias("legendaries"), F.countDistinct(F.nullif(F.col("_studio"), F.lit(""))).alias("studios"))
    return rank_board(out, ["season_id"], [F.desc("points"), F.desc("pieces"), F.asc("collector_name"), F.asc("collector_uid")])


def collectors_board(claims: DataFrame, entries: DataFrame, badges: DataFrame) -> DataFrame:
    """Every collector over all seasons."""
    c = claims.where(F.col("status").isin(*HELD)).join(entries.select(F.col("id").alias("entry_id"), "studio"), "entry_id", "left")
    own = c.groupBy("collector_uid").agg(F.coalesce(F.max("collector_name"), F.lit("A collector")).alias("collector_name"), F.countDistinct("object_row_id").alias("pieces"), F.countDistinct(F.nullif(F.col("studio"), F.lit(""))).alias("studios"), F.countDistinct("season_id").alias("seasons"), F.min("created_at").alias("since"))
    b = badges.groupBy(F.col("uid").alias("collector_uid")).agg(F.count("*").alias("badges"))
    out = own.join(b, "collector_uid", "left").fillna(0, ["badges"])
    return rank_all(out, [F.desc("pieces"), F.desc("studios"), F.desc("badges"), F.asc("since"), F.asc("collector_uid")])


def award_standings(entries: DataFrame, categories: DataFrame, award_votes: DataFrame, top: int = 5) -> DataFrame:
    """season_id, category_id, id, value, rank by each category (season_id, category_id, kind, solo_only).

    A vote category lists the `top` entries by picks, a measured one every entry with a height, the tallest first; a category
    for solo makers takes their entries alone. value is the number of picks or the height.
    """
    picks = award_votes.groupBy("season_id", "category_id", F.col("entry_id").alias("id")).agg(F.count("*").cast("double").alias("value"))
    own = entries.select("season_id", "id", "created_at", "solo", "height_mm")
    voted = categories.where("kind = 'vote'").join(picks, ["season_id", "category_id"]).join(own, ["season_id", "id"])
    tall = categories.where("kind = 'measured'").join(own.where("height_mm IS NOT NULL"), "season_id").withColumn("value", F.col("height_mm").cast("double"))
    both = voted.select(*(cols := ["season_id", "category_id", "kind", "solo_only", "id", "created_at", "solo", "value"])).unionByName(tall.select(*cols)).where("NOT solo_only OR solo")
    board = rank_board(both, ["season_id", "category_id"], [F.desc("value"), F.asc_nulls_first("created_at"), F.asc("id")])
    return board.where((F.col("kind") == "measured") | (F.col("rank") <= top)).select("season_id", "category_id", "id", "value", "rank")


def measured_award(entries: DataFrame, measure: str = "height_mm") -> DataFrame:
    board = entries.where(F.col(measure).isNotNull()).select("season_id", "id", F.col(measure).alias("value"), "created_at")
    return rank_board(board, ["season_id"], [F.desc("value"), F.asc("created_at"), F.asc("id")]).drop("created_at")


def first_timers(entries: DataFrame) -> DataFrame:
    """season_id, artist_uid of makers who have entries in that season alone."""
    own = entries.where("coalesce(artist_uid, '') <> ''").groupBy("artist_uid").agg(F.min("season_id").alias("season_id"), F.max("season_id").alias("_last"))
    return own.where("season_id = _last").select("season_id", "artist_uid")


def prize_standings(counted_: DataFrame, claims: DataFrame, entries: DataFrame, top: int = 3) -> DataFrame:
    """season_id, awarded_for, rank, name, value: the first `top` of every board that a prize can be awarded for."""
    # Written once, as twelve boards read them.
    counted_ = cut(counted_)
    studios, makers, points = cut(studio_board(counted_).where("NOT independent").drop("rank")), cut(maker_board(counted_).drop("rank")), cut(points_board(counted_, claims).drop("rank"))
    rookies = makers.join(first_timers(entries).withColumnRenamed("artist_uid", "maker"), ["season_id", "maker"], "left_semi")

    def board(kind: str, df: DataFrame, name: str, metric: str, then: list[Column]) -> DataFrame:
        best = rank_board(df.where(F.col(metric) > 0), ["season_id"], [F.desc(metric), *then])
        return best.where(F.col("rank") <= top).select("season_id", F.lit(kind).alias("awarded_for"), "rank", F.col(name).cast("string").alias("name"), F.col(metric).cast("long").alias("value"))

    piece = [F.asc("created_at"), F.asc("id")]
    shop = [F.desc("entries"), F.desc("claims"), F.desc("votes"), F.lower("studio")]
    maker = [F.desc("registered"), F.desc("entries"), F.desc("votes"), F.lower("artist_name"), F.asc("maker")]
    holder = [F.desc("points"), F.desc("pieces"), F.lower("collector_name"), F.asc("collector_uid")]
    boards = [board("peoples_choice", counted_, "title", "vote_count", piece), board("most_collected", counted_, "title", "claim_count", [F.desc("vote_count"), *piece])]
    boards += [board(f"studio_{k}", studios, "studio", m, shop) for k, m in (("most_makers", "makers"), ("most_pieces", "entries"), ("most_collected", "claims"))]
    boards += [board(f"maker_{k}", makers, "artist_name", m, maker) for k, m in (("most_registered", "registered"), ("most_collected", "claims"), ("most_votes", "votes"))]
    boards += [board("rookie", rookies, "artist_name", "votes", maker)]
    boards += [board(f"collector_{k}", points, "collector_name", m, holder) for k, m in (("most_points", "points"), ("most_pieces", "pieces"), ("most_studios", "studios"))]
    return reduce(DataFrame.unionByName, boards)


def holds_all(holdings: DataFrame, universe: DataFrame, group: str, item: str, who: str, least: int = 2) -> DataFrame:
    """group, who: those that hold every item of a group which has at least `least`."""
    total = universe.select(group, item).distinct().groupBy(group).agg(F.count("*").alias("_all")).where(F.col("_all") >= least)
    own = holdings.join(universe.select(group, item).distinct(), [group, item], "left_semi").groupBy(group, who).agg(F.countDistinct(item).alias("_own"))
    return own.join(total, group).where("_own = _all").select(group, who)


def badges(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """uid, badge, season_id (0 for those that aren't of a season): every badge earned."""
    c = claims.where(F.col("status").isin(*HELD)).join(entries.select(F.col("id").alias("entry_id"), "studio", "legendary"), "entry_id", "left").withColumn("studio", F.nullif(F.col("studio"), F.lit("")))
    per = c.groupBy(F.col("collector_uid").alias("uid")).agg(F.bool_or(F.coalesce("legendary", F.lit(False))).alias("found"), F.countDistinct("studio").alias("studios"), F.countDistinct("season_id").alias("seasons"))
    earned = F.array_compact(F.array(F.lit("first-scan"), F.when(F.col("found"), "legend_hunter"), F.when(F.col("studios") >= 5, "five-shops"), F.when(F.col("seasons") >= 3, "three-seasons")))
    personal = per.select("uid", F.explode(earned).alias("badge"), F.lit(0).alias("season_id"))
    debut = entries.where("coalesce(artist_uid, '') <> ''").select(F.col("artist_uid").alias("uid"), F.lit("maker-debut").alias("badge"), F.lit(0).alias("season_id")).distinct()
    shops = entries.where("coalesce(studio, '') <> ''")
    complete = holds_all(c.where("studio IS NOT NULL"), shops, "season_id", "studio", "collector_uid").select(F.col("collector_uid").alias("uid"), F.lit("set-complete").alias("badge"), F.col("season_id").cast("int"))
    return personal.unionByName(debut).unionByName(complete)


def career(counted_: DataFrame) -> DataFrame:
    """For each maker: events, entries, votes, collected, best rank over all seasons."""
    per = counted_.groupBy("artist_uid").agg(F.countDistinct("season_id").alias("events"), F.count("*").alias("entries"), F.sum("vote_count").alias("votes"), F.sum("claim_count").alias("collected"))
    best = best_rank(peoples_choice(counted_)).groupBy("artist_uid").agg(F.min("best_rank").alias("best_rank"))
    return per.join(best, "artist_uid", "left")


def completeness(df: DataFrame, fields: dict[str, tuple[int, Column]]) -> DataFrame:
    """percent of the weights whose condition holds, half to even, and the list of missing fields."""
    total = sum(w for w, _ in fields.values())
    got = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for w, c in fields.values()])
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(f)) for f, (_, c) in fields.items()]))
    return df.withColumn("percent", F.bround(100.0 * got / total).cast("int")).withColumn("missing", missing)


#: The least score of each level.
LEVELS = ((80, "on the record"), (60, "well known"), (40, "known"), (20, "a sketch"), (0, "barely known"))


def level(score: Column) -> Column:
    """The word for a knowledge score."""
    return F.coalesce(*[F.when(score >= least, word) for least, word in LEVELS])


def knowledge_score(percent: Column, pieces: Column, registered: Column, events: Column, votes: Column, collected: Column, awards: Column, prizes: Column, badges_: Column, external: Column) -> Column:
    """0 to 100: profile 40, pieces 20, registered 10, events 10, recognition 10, outside links 10; roundings half to even."""
    profile = F.bround(0.4 * percent)
    pieces_ = F.when(pieces > 0, F.least(F.lit(20.0), F.bround(20 * F.log1p(pieces) / F.log(F.lit(31.0))))).otherwise(0.0)
    registered_ = F.when(pieces > 0, F.bround(10.0 * registered / pieces)).otherwise(0.0)
    recognition = F.least(F.lit(10.0), F.bround(votes / 5 + collected * 2 + awards * 3 + prizes * 4 + badges_))
    return F.least(F.lit(100.0), profile + pieces_ + registered_ + F.least(F.lit(10), 4 * events) + recognition + F.least(F.lit(10), external)).cast("int")


def within_cap(votes: DataFrame, cap: int) -> DataFrame:
    """The first `cap` votes of each voter and season by time and id."""
    n = F.row_number().over(Window.partitionBy("season_id", "voter_uid").orderBy("created_at", "id"))
    return votes.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def fold_votes(toggles: DataFrame, cap: int) -> DataFrame:
    """season_id, voter_uid, entry_id of the votes that stand after toggles (id, created_at) in order.

    A toggle takes back a standing vote, else casts one unless the voter has `cap` standing in the season. The fold needs
    the running state, so each voter's season is folded in order by one task; a voter's toggles are few.
    """

    def fold(pdf):
        standing: dict = {}
        for e in pdf.sort_values(["created_at", "id"])["entry_id"]:
            if e in standing:
                del standing[e]
            elif len(standing) < cap:
                standing[e] = True
        return type(pdf)({"season_id": pdf["season_id"].iloc[0], "voter_uid": pdf["voter_uid"].iloc[0], "entry_id": list(standing)})

    kinds = dict(toggles.dtypes)
    return toggles.groupBy("season_id", "voter_uid").applyInPandas(fold, f"season_id {kinds['season_id']}, voter_uid {kinds['voter_uid']}, entry_id {kinds['entry_id']}")


def fold_picks(picks: DataFrame) -> DataFrame:
    """The current pick of each voter, season and category: the last one, unless it repeats the one before (then none)."""
    w = Window.partitionBy("season_id", "category_id", "voter_uid").orderBy("created_at", "id")
    # A run of equal picks alternates between set and removed, so its parity decides.
    run = picks.withColumn("_new", (~F.col("entry_id").eqNullSafe(F.lag("entry_id").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    ends = run.groupBy("season_id", "category_id", "voter_uid", "_run").agg(F.count("*").alias("_n"), F.max("entry_id").alias("entry_id"))
    last = F.row_number().over(Window.partitionBy("season_id", "category_id", "voter_uid").orderBy(F.desc("_run")))
    return ends.withColumn("_at", last).where("_at = 1 AND _n % 2 = 1").select("season_id", "category_id", "voter_uid", "entry_id")
