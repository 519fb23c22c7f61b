"""Entity resolution: clusters of equal names, canonical members, changes between two stagings."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import fold, norm
from tessera.operators.graph import components
from tessera.shared import cut

#: Titles before a name; the ratio of near names.
TITLES = r"^(mr|mrs|ms|dr|prof|sir|dame)\.? +"
NEAR = 0.94
#: Letters of a name up to which no other name's ratio is rounded to 100.0.
SETTLED = 900
#: Kinds of items that are looked through for duplicates.
KINDS = ("person", "studio", "place", "school", "museum", "funder", "show")


def pick_canonical(items: DataFrame, by: list[str], order: list) -> DataFrame:
    """items with canonical (the key of the first in its group by `order`), members and is_canonical."""
    group = Window.partitionBy(*by)
    ranked = items.withColumn("canonical", F.first("key").over(group.orderBy(*order))).withColumn("members", F.count("*").over(group))
    return ranked.withColumn("is_canonical", F.col("key") == F.col("canonical"))


def fold_duplicates(clustered: DataFrame) -> DataFrame:
    """One row per canonical key: kind, the number of members, and the other keys in order (comma-joined)."""
    others = F.array_sort(F.collect_list(F.when(~F.col("is_canonical"), F.col("key"))))
    return clustered.groupBy("canonical").agg(F.first("kind").alias("kind"), F.count("*").alias("members"), F.array_join(others, ",").alias("extra_keys"))


def cluster_report(clustered: DataFrame) -> DataFrame:
    """kind, clusters, duplicates: per kind, the clusters of several members and what folding removes."""
    several = clustered.where("is_canonical AND members > 1")
    return several.groupBy("kind").agg(F.count("*").alias("clusters"), F.sum(F.col("members") - 1).alias("duplicates"))


def change_status(prev: DataFrame, now: DataFrame) -> DataFrame:
    """key, status after a staging: prev has key, status, content_hash, pushed_hash, qid; now has key, content_hash.

    New keys are new. Pushed or changed ones are pushed if the content is what was pushed, else changed. An orphan that is
    back is changed if it has a qid, else new. A failed one with other content is ready if it has a qid, else new. Others
    keep their status. Of keys that are gone, those with a qid become orphans, the others are dropped.
    """
    old = prev.select("key", F.lit(True).alias("was"), "status", F.col("content_hash").alias("old_hash"), "pushed_hash", "qid")
    both = old.join(now.select("key", F.lit(True).alias("is"), "content_hash"), "key", "full")
    has = F.coalesce(F.col("qid"), F.lit("")) != ""
    kept = F.when(F.col("status").isin("pushed", "changed"), F.when(F.col("pushed_hash").eqNullSafe(F.col("content_hash")), "pushed").otherwise("changed"))
    kept = kept.when(F.col("status") == "orphan", F.when(has, "changed").otherwise("new"))
    kept = kept.when((F.col("status") == "failed") & ~F.col("old_hash").eqNullSafe(F.col("content_hash")), F.when(has, "ready").otherwise("new")).otherwise(F.col("status"))
    return both.select("key", F.when(F.col("is").isNull(), F.when(has, "orphan").otherwise("dropped")).when(F.col("was").isNull(), "new").otherwise(kept).alias("status"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of characters in common blocks, as difflib counts them."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def name_key(c: Column) -> Column:
    """A name's folded words in order of the alphabet, without a title."""
    return F.array_join(F.array_sort(F.split(fold(F.regexp_replace(F.lower(F.trim(c)), TITLES, "")), " ")), " ")


def _same(items: DataFrame, key: str, *by: str) -> DataFrame:
    """a, b: each row of a group tied to the group's smallest key; groups are summed up first, so a hot name is no hot task."""
    own = items.where(F.col(by[-1]) != "")
    first = own.groupBy(*by).agg(F.min(key).alias("_first"))
    return own.join(first, list(by)).select(F.col("_first").alias("a"), F.col(key).alias("b")).where("a <> b")


def near_names(df: DataFrame, key: str, name: str, block: str, threshold: float = NEAR) -> DataFrame:
    """a, b, ratio: keys whose names differ, begin alike (block) and are near: one's words are all among the other's (names that differ in
    at most one word are so too), and the ratio reaches the threshold.

    So the name with fewer words meets those that have its rarest word and a length that the ratio allows: a word that most names
    share brings hardly any pairs.
    """
    names = df.select(F.col(block).alias("block"), F.col(name).alias("n"), F.col(key).alias("k")).where("n <> ''").groupBy("block", "n").agg(F.min("k").alias("k")).withColumn("w", F.array_distinct(F.split("n", " ")))
    spread = names.withColumn("part", F.explode("w"))
    often = spread.groupBy("block", "part").agg(F.count("*").alias("often"))
    rare = spread.join(often, ["block", "part"]).groupBy("block", "n", "k", "w").agg(F.min(F.struct("often", "part"))["part"].alias("part"))
    size = F.length("n")
    fits = F.sequence(F.ceil(size * threshold / (2 - threshold) - 1e-9), F.floor(size * (2 - threshold) / threshold + 1e-9))
    x = rare.withColumn("size", F.explode(fits)).toDF("block", "na", "ka", "wa", "part", "size")
    y = spread.withColumn("size", size.cast("long")).toDF("block", "nb", "kb", "wb", "part", "size")
    pairs = x.join(y, ["block", "part", "size"]).where("na <> nb AND size(array_except(wa, wb)) = 0")
    flip = F.col("na") > F.col("nb")
    pairs = pairs.select(*(F.when(flip, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(f"{c}a") for c in "nk"), *(F.when(flip, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(f"{c}b") for c in "nk")).distinct()
    return pairs.withColumn("ratio", ratio("na", "nb")).where(F.col("ratio") >= threshold).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ratio")


def cluster_items(items: DataFrame, links: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """items (key, kind, label, city) with cluster: the smallest key of those that are the same; items of other kinds are their own.

    The same are: equal names (studios: and city; all of a name if it has one city at most), a shared link (links: key, link),
    and near names that begin with the same letter. Kinds never mix.
    """
    own = items.where(F.col("kind").isin(*kinds)).withColumn("name", name_key(F.col("label"))).withColumn("city", F.coalesce("city", F.lit("")))
    studio = F.col("kind") == "studio"
    placed = own.withColumn("_city", F.when(studio, F.col("city")).otherwise(""))
    edges = [_same(placed, "key", "kind", "_city", "name")]
    one_city = own.where(studio & (F.col("name") != "")).groupBy("name").agg(F.countDistinct(F.nullif("city", F.lit(""))).alias("n")).where("n <= 1").select("name")
    edges.append(_same(own.where(studio).join(one_city, "name", "left_semi"), "key", "kind", "name"))
    if links is not None:
        edges.append(_same(own.join(links, "key"), "key", "kind", "link"))
    first = F.concat_ws("|", "kind", F.left("name", F.lit(1)))
    edges.append(near_names(own.withColumn("_block", first), "key", "name", "_block").select("a", "b"))
    root = components(reduce(DataFrame.unionByName, edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("key"), "root")
    return items.join(root, "key", "left").withColumn("cluster", F.coalesce("root", "key")).drop("root")


def apply_review(items: DataFrame, review: DataFrame) -> DataFrame:
    """items (key, label, description, aliases, claims: array<struct<p, v>>) with a reviewer's edits.

    review: key, label, description, aliases (null: as it is), drop (properties), add (claims). Added claims come last, once.
    """
    r = review.select("key", *[F.col(c).alias(f"_{c}") for c in ("label", "description", "aliases", "drop", "add")])
    both = items.join(r, "key", "left")
    left = F.filter("claims", lambda c: ~F.coalesce(F.array_contains("_drop", c["p"]), F.lit(False)))
    claims = F.when(F.col("_add").isNull(), left).otherwise(F.array_distinct(F.concat(left, "_add")))
    text = {c: F.coalesce(f"_{c}", c) for c in ("label", "description", "aliases")}
    return both.withColumns(text | {"claims": claims}).select(*items.columns)


def reconcile(queries: DataFrame, items: DataFrame, top: int = 5, least: float = 60.0) -> DataFrame:
    """query, rank, key, score, match: candidates for each query by name (items: key, label, aliases).

    100 for the label, 99 for an alias, else the best ratio in percent, 90 at least if all words of the query are in the label.
    A query meets the names that share a word or the first two letters with it. Two exact candidates match neither.

    Equal names meet first. A query that has `top` equal labels meets no others, as none can come before those; else a ratio
    is counted only where the lengths of both names let it reach `least`.
    """
    parts = lambda c: F.array_distinct(F.concat(F.split(c, " "), F.array(F.left(c, F.lit(2)))))
    q = queries.select("query", norm(F.col("query")).alias("nq")).where("nq <> ''").distinct()
    names = items.select("key", "label", F.explode(F.concat(F.array(F.struct(norm(F.col("label")).alias("n"), F.lit(True).alias("own"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(norm(a).alias("n"), F.lit(False).alias("own"))))).alias("a")).select("key", "label", "a.*").where("n IS NOT NULL")
    labels = names.where("own").select("key", F.col("n").alias("nq")).distinct().groupBy("nq").agg(F.count("*").alias("equal"))
    told = q.join(labels, "nq", "left").withColumn("settled", F.coalesce((F.col("equal") >= top) & (F.length("nq") <= SETTLED), F.lit(False)))
    equal = told.where("settled").join(names.withColumnRenamed("n", "nq"), "nq").select("query", "key", "label", F.when(F.col("own"), 100.0).otherwise(99.0).alias("s"))
    open_ = told.where("NOT settled").select("query", "nq")
    met = open_.withColumn("part", F.explode(parts(F.col("nq")))).join(names.withColumn("part", F.explode(parts(F.col("n")))), "part").select("query", "nq", "key", "label", "n", "own").distinct()
    subset = F.col("own") & (F.size(F.array_except(F.split("nq", " "), F.split("n", " "))) == 0)
    x, y = F.length("nq"), F.length("n")
    met = met.withColumn("subset", subset).where(F.col("subset") | (200 * F.least(x, y) >= (least - 1) * (x + y)))
    share = F.when(F.col("nq") == F.col("n"), F.when(F.col("own"), 100.0).otherwise(99.0)).otherwise(F.greatest(100 * ratio("nq", "n"), F.when(F.col("subset"), 90.0).otherwise(0.0)))
    scored = equal.unionByName(met.select("query", "key", "label", share.alias("s"))).groupBy("query", "key", "label").agg(F.round(F.max("s"), 1).alias("score")).where(F.col("score") >= least)
    by = Window.partitionBy("query").orderBy(F.desc("score"), "label", "key")
    best = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    exact = F.count_if(F.col("score") >= 99).over(Window.partitionBy("query"))
    return best.select("query", "rank", "key", "score", ((F.col("score") >= 99) & (exact == 1)).alias("match"))


def alias_match(people: DataFrame, index: DataFrame) -> DataFrame:
    """key, status, index_id: one namesake by label or alias is matched, several are unsure, none is unmatched.

    people: key, label, aliases. index: index_id, label, aliases.
    """
    every = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), norm))).alias("n")).where("n <> ''")
    hits = every(people, "key").join(every(index, "index_id"), "n").groupBy("key").agg(F.countDistinct("index_id").alias("n"), F.min("index_id").alias("first"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "unsure").otherwise("unmatched")
    return people.select("key").join(hits, "key", "left").select("key", status.alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("index_id"))


def match_by_name(left: DataFrame, right: DataFrame, left_col: str, right_col: str, priority: list[Column]) -> DataFrame:
    """left with the columns of the right row whose name is equal (spaces and case aside), the first by priority."""
    first = F.row_number().over(Window.partitionBy("_k").orderBy(*priority))
    own = right.withColumn("_k", norm(F.col(right_col))).where("_k <> ''").withColumn("_n", first).where("_n = 1").drop("_n")
    return left.withColumn("_k", norm(F.col(left_col))).join(own, "_k", "left").drop("_k")


def merge_by_name(sources: list[DataFrame], name: str = "name") -> DataFrame:
    """One row for each name (spaces and case aside): its first spelling in order, and the sums of the other columns."""
    metrics = list(dict.fromkeys(c for s in sources for c in s.columns if c != name))
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged).withColumn("_k", norm(F.col(name))).where("_k <> ''")
    return both.groupBy("_k").agg(F.min_by(name, F.struct("_source", name)).alias(name), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics]).drop("_k")


def decide_links(found: DataFrame, places: list[str]) -> DataFrame:
    """key, status, candidate: of candidates with the exact name, those of the narrowest place that agrees.

    found: key, label, candidate, name, and for each of places (narrowest first) a boolean or null (not known). One left is
    matched, several are unsure, none is unmatched; keys without a candidate name are unmatched too.
    """
    level = F.coalesce(*[F.when(F.col(p), i) for i, p in enumerate(places)], F.lit(len(places)))
    against = reduce(lambda a, b: a | b, [F.coalesce(~F.col(p), F.lit(False)) for p in places])
    exact = found.where(norm(F.col("label")) == norm(F.col("name"))).where(~(against & (level == len(places)))).withColumn("level", level)
    best = exact.withColumn("best", F.min("level").over(Window.partitionBy("key"))).where("level = best")
    own = best.groupBy("key").agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("first"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "unsure").otherwise("unmatched")
    return found.select("key").distinct().join(own, "key", "left").select("key", status.alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("candidate"))


def drift_report(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """key, drift: how the published copy differs from ours (key, label, claims: array<string>): missing, label, added, ok.

    added: it has statements that ours lacks. A label that differs is named before statements.
    """
    t = theirs.select("key", F.lit(True).alias("there"), F.col("label").alias("tl"), F.col("claims").alias("tc"))
    kind = F.when(F.col("there").isNull(), "missing").when(~F.col("label").eqNullSafe(F.col("tl")), "label").when(F.size(F.array_except("tc", "claims")) > 0, "added").otherwise("ok")
    return ours.join(t, "key", "left").select("key", kind.alias("drift"))


def property_usage(items: DataFrame) -> DataFrame:
    """p, n, n_items of the claims' properties."""
    return items.select("key", F.explode("claims").alias("c")).groupBy(F.col("c.p").alias("p")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_items"))


def write_plan(items: DataFrame, live: DataFrame) -> DataFrame:
    """key, action of a dry run: create, update, skip-current, skip-exists or skip-unresolved.

    items: key, qid, content_hash, pushed_hash, refs (keys that statements point to), canonical (another key, or null). live: key,
    qid of what exists already. A reference follows `canonical` up to five times and must end at an item that has, or in this plan
    gets, an id. An item without qid whose key exists is not created again.
    """
    at = items.select("key", F.coalesce("canonical", "key").alias("to"))
    for _ in range(4):
        step = items.select(F.col("key").alias("to"), F.coalesce("canonical", "key").alias("next"))
        at = at.join(step, "to", "left").select("key", F.coalesce("next", "to").alias("to"))
    ends = at.join(items.select(F.col("key").alias("to"), F.lit(True).alias("known")), "to", "left").select(F.col("key").alias("ref"), F.coalesce("known", F.lit(False)).alias("known"))
    refs = items.select("key", F.explode("refs").alias("ref")).join(ends, "ref", "left").groupBy("key").agg(F.bool_or(~F.coalesce("known", F.lit(False))).alias("open"))
    both = items.join(refs, "key", "left").join(live.select("key", F.lit(True).alias("exists")), "key", "left")
    has = F.coalesce("qid", F.lit("")) != ""
    action = F.when(F.coalesce("open", F.lit(False)), "skip-unresolved").when(~has & F.col("exists").isNotNull(), "skip-exists").when(~has, "create").when(F.col("content_hash").eqNullSafe(F.col("pushed_hash")), "skip-current").otherwise("update")
    return both.select("key", action.alias("action"))


def apply_splits(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (key, status, canonical, qid, different) after a reviewer's decisions (key) that duplicates are things of their own.

    The duplicate stands alone (status split) and names what it was folded into as different; that one names it too, and is changed if
    it was published. Decisions on items that aren't folded do nothing.
    """
    split = items.join(decisions.select("key").distinct(), "key", "left_semi").where("coalesce(canonical, '') <> ''").select("key", F.col("canonical").alias("_from"))
    kept = split.groupBy(F.col("_from").alias("key")).agg(F.array_sort(F.collect_set("key")).alias("_apart"))
    both = items.join(split, "key", "left").join(kept, "key", "left")
    alone = F.col("_from").isNotNull()
    changed = F.col("_apart").isNotNull() & (F.coalesce("qid", F.lit("")) != "")
    more = F.array_compact(F.concat(F.array("_from"), F.coalesce("_apart", F.array().cast("array<string>"))))
    return both.select("key", F.when(alone, "split").when(changed, "changed").otherwise(F.col("status")).alias("status"), F.when(alone, F.lit("")).otherwise(F.col("canonical")).alias("canonical"), "qid", F.array_union("different", more).alias("different"))


def select_to_check(items: DataFrame, decided: DataFrame, recheck: bool = False) -> DataFrame:
    """key, step for each item (key, label, status, qid): known, decided, checked, or ask.

    decided: key, label, status, qid of earlier lookups. An item with an id is known unless the lookup itself set it and everything is
    rechecked; a person's decision stands; one looked up under the same label is checked unless rechecked. Skipped items and
    duplicates have no row.
    """
    d = decided.select("key", F.col("label").alias("_label"), F.col("status").alias("_status"), F.col("qid").alias("_qid"))
    both = items.where("status NOT IN ('skipped', 'duplicate')").join(d, "key", "left")
    has = F.coalesce(F.trim("qid"), F.lit("")) != ""
    mine = F.coalesce((F.col("_status") == "matched") & (F.col("_qid") == F.col("qid")), F.lit(False))
    asked = F.col("_status").isNotNull() & (F.col("_status") != "known")
    step = F.when(has & ~(mine & F.lit(recheck)), "known").when(F.col("_status").isin("confirmed", "rejected"), "decided").when(asked & F.lit(not recheck) & F.col("label").eqNullSafe(F.col("_label")), "checked").otherwise("ask")
    return both.select("key", step.alias("step"))


def valid_proposals(proposals: DataFrame) -> DataFrame:
    """key, field, value, confidence of the proposals that can be used: a link for website, a handle for instagram, any text for city."""
    v = F.trim(F.coalesce("value", F.lit("")))
    handle = F.element_at(F.split(F.regexp_replace(F.regexp_replace(v, "^@+", ""), "/+$", ""), "/"), -1)
    value = F.when((F.col("field") == "website") & v.rlike("^https?://[^\\s<>\"']{4,500}$"), v).when((F.col("field") == "instagram") & handle.rlike("^[A-Za-z0-9_.]{2,30}$"), handle).when((F.col("field") == "city") & (v != ""), F.left(v, F.lit(120)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.0))))
    return proposals.select("key", "field", value.alias("value"), sure.alias("confidence")).where("value IS NOT NULL")


def near_anchors(links: DataFrame, anchors: DataFrame, ours: DataFrame) -> DataFrame:
    """person, n, anchors: people outside who are linked to our anchors, less those we hold; links: person, name, to. ours: id, name."""
    near = links.join(anchors.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    near = near.join(ours.select(F.col("id").alias("person")), "person", "left_anti")
    near = near.withColumn("_k", norm(F.col("name"))).join(ours.select(norm(F.col("name")).alias("_k")).where("_k <> ''").distinct(), "_k", "left_anti")
    return near.groupBy("person").agg(F.countDistinct("to").alias("n"), F.array_join(F.array_sort(F.collect_set("to")), ",").alias("anchors"))


def import_review(items: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, report) after a reviewer's sheet (key, label, description, merge_into; blank cells change nothing).

    A row that is merged into another key becomes its duplicate. The report counts edited, merged and unknown rows.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    r = sheet.select("key", text("label").alias("_label"), text("description").alias("_description"), text("merge_into").alias("_into"))
    both = items.join(r, "key", "left")
    out = both.withColumns({"label": F.coalesce("_label", "label"), "description": F.coalesce("_description", "description"), "canonical": F.coalesce("_into", "canonical"), "status": F.when(F.col("_into").isNotNull(), "duplicate").otherwise(F.col("status"))}).select(*items.columns)
    seen = r.join(items.select("key", F.col("label").alias("l"), F.col("description").alias("d"), F.lit(True).alias("known")), "key", "left")
    edited = F.col("known") & ((~F.coalesce(F.col("_label") == F.col("l"), F.col("_label").isNull())) | (~F.coalesce(F.col("_description") == F.col("d"), F.col("_description").isNull())))
    return out, seen.agg(F.count_if(edited).alias("edited"), F.count_if(F.col("known") & F.col("_into").isNotNull()).alias("merged"), F.count_if(F.col("known").isNull()).alias("unknown"))


#: Sources of items, the most trusted first; others come after.
SOURCES = {"artists": 0, "profiles": 1, "artist_submissions": 2, "artists_legacy": 3, "museum_artists": 4, "commissions": 5, "lineage_submissions": 6, "objects": 7, "studios": 0, "studio_submissions": 1, "studios_directory_legacy": 2, "season_entries": 3}
KEY_PROP = "registry key"


def fold_clusters(items: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: key, status, canonical, cluster, note, aliases; claims: key, n, prop, kind, value, extra, quals) after clusters were folded.

    items: key, kind, label, description, aliases, tbl, status, qid, cluster (of cluster_items). Of a cluster's members one that is published (has
    a qid) is canonical, else the one of the most trusted source, then with most claims, then the longest description, then the smallest
    key. Others become its duplicates, but for those a reviewer has split off. The canonical item gains their claims, labels and aliases that
    it doesn't have, and their keys; if it was pushed and gains anything it is changed. Who is alone again after having been a
    duplicate is ready, if published, else new. Other claims stay as they are, so do those of duplicates.
    """
    n = claims.groupBy("key").agg(F.count("*").alias("_claims"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv)), F.col("tbl")), F.lit(50))
    has = F.coalesce("qid", F.lit("")) != ""
    order = F.struct((~has).alias("a"), rank.alias("b"), (-F.coalesce("_claims", F.lit(0))).alias("c"), (-F.length(F.coalesce("description", F.lit("")))).alias("d"), "key")
    own = items.join(n, "key", "left").withColumn("_order", order)
    best = own.groupBy("cluster").agg(F.min("_order")["key"].alias("_best"), F.count("*").alias("_members"))
    own = own.join(best, "cluster")
    alone, first, split = F.col("_members") == 1, F.col("key") == F.col("_best"), F.col("status") == "split"
    duplicate = ~alone & ~first & ~split
    own = cut(own.withColumn("_dup", duplicate))
    dup = own.where("_dup").select("key", F.col("_best").alias("to"), "label", "aliases", "qid")
    same = ["prop", "kind", "value", "extra", "quals"]
    moved = claims.where(F.col("prop") != KEY_PROP).join(dup.select("key", "to"), "key").select(F.col("to").alias("key"), F.lit(1).alias("_part"), F.concat(F.col("key"), F.lpad("n", 9, "0")).alias("_at"), *same)
    keys = dup.select(F.col("to").alias("key"), F.lit(2).alias("_part"), F.col("key").alias("_at"), F.lit(KEY_PROP).alias("prop"), F.lit("ext").alias("kind"), F.col("key").alias("value"), F.lit(None).cast("string").alias("extra"), F.array().cast(dict(claims.dtypes)["quals"]).alias("quals"))
    kept = claims.select("key", F.lit(0).alias("_part"), F.lpad("n", 9, "0").alias("_at"), *same)
    every = kept.unionByName(moved).unionByName(keys).groupBy("key", *same).agg(F.min(F.struct("_part", "_at")).alias("_o"))
    gained = every.where("_o._part > 0").select("key").distinct().withColumn("_gained", F.lit(True))
    folded = every.select("key", F.row_number().over(Window.partitionBy("key").orderBy("_o", "prop", "value")).alias("n"), *same)
    names = dup.select(F.col("to").alias("key"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("x")).where("coalesce(x, '') <> ''").groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("_more"))
    out = own.join(names, "key", "left").join(gained, "key", "left")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda x: (x != F.col("label")) & ~F.array_contains(aliases, x))
    status = F.when(F.col("_dup"), "duplicate").when(alone & (F.col("status") == "duplicate"), F.when(has, "ready").otherwise("new")).when((F.col("status") == "pushed") & (F.col("_gained") | (F.size(more) > 0)), "changed").otherwise(F.col("status"))
    other = own.select(F.col("key").alias("_best"), F.col("qid").alias("_qid"))
    out = out.join(other, "_best")
    both = has & (F.coalesce("_qid", F.lit("")) != "") & (F.col("qid") != F.col("_qid"))
    note = F.when(F.col("_dup"), F.when(both, F.concat(F.lit("also published as "), "qid")).otherwise(F.concat(F.lit("same "), "kind", F.lit(" as "), "_best")))
    return out.select("key", status.alias("status"), F.when(F.col("_dup"), F.col("_best")).alias("canonical"), F.when(~alone, F.concat(F.lit("c:"), "_best")).alias("cluster"), note.alias("note"), F.when(F.col("_dup"), aliases).otherwise(F.concat(aliases, more)).alias("aliases")), folded
