"""Rows of many tables staged into typed items with claims, which name each other by key.

A source turns its rows into drafts: an item that may be made, the claims that it makes, and claims that go to a person whom an
earlier source made. Values that are still words (names, terms, places) are resolved over all drafts at once. Whatever order rows
come in, the answer is the same: sources have a rank, and rows of one source go by their id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.places import country_label, with_place
from tessera.functions.text import clean_blank, clip, collapse, fold, fold_exact, looks_like_name
from tessera.operators.tables import HOUSEKEEPING, is_private
from tessera.operators.terms import resolve_terms, vocabulary
from tessera.shared import cut

#: Columns that may hold a meaning, the best first.
COLUMNS = {
    "name": "artist_name display_name full_name name artist maker", "studio": "name studio_name studio shop organization", "city": "city town city_town",
    "region": "region state state_region province state_province", "country": "country nation", "based": "based_in nationality_base location based where_based based_city",
    "web": "website url web link site website_or_social homepage", "instagram": "instagram instagram_handle ig social", "technique": "tech_primary primary_technique techniques technique primary_techniques",
    "technique2": "tech_secondary secondary_technique secondary_techniques", "technique3": "tech_occasional occasional_technique occasional_techniques", "roles": "roles role",
    "type": "type studio_type kind category", "founded": "founded year_founded established inception since year", "lat": "lat latitude", "lng": "lng lon long longitude",
    "institution": "institution school university college name", "program": "program_department program department program_name degree",
    "show": "event_show_name show_event_exhibition_name show fair event event_name name title opportunity_title opportunity", "start": "event_start start start_date starts date dates when deadline",
    "end": "event_end end end_date ends", "museum": "museum institution collection", "held": "artist artist_name name", "recipient": "artist artist_name recipient name", "year": "year date",
    "funder": "funding_source source funder organization name", "student": "student_name student", "mentor": "mentor_name mentor teacher", "relation": "relation", "years": "years year when", "where": "where studio school",
}
COLUMNS = {k: v.split() for k, v in COLUMNS.items()}
#: How studios are classed by words of their type, the first that fits.
STUDIO_CLASSES = [("hot shop", "hot-shop"), ("hot", "hot-shop"), ("furnace", "hot-shop"), ("hotshop", "hot-shop"), ("glassblowing", "hot-shop"), ("flameworking", "flame-shop"), ("flame", "flame-shop"), ("torch", "flame-shop"), ("lampworking", "flame-shop"),
    ("kiln fusing", "kiln-studio"), ("kiln", "kiln-studio"), ("fusing", "kiln-studio"), ("casting", "kiln-studio"), ("cold shop", "cold-shop"), ("cold", "cold-shop"), ("coldworking", "cold-shop"), ("teaching", "teaching-studio"), ("school", "teaching-studio"), ("access", "teaching-studio"), ("mixed", "mixed-studio")]
#: What descriptions are made of.
WORDS = {"person": "glass artist", "held": "glass artist held in museum collections", "awarded": "glass artist, award recipient", "maker": "glass maker", "studio": "glass studio", "museum": "museum holding glass", "school": "school with a glass program", "funder": "funder of work in glass", "season": "collecting event", "object": "glass piece"}

QUAL = "struct<prop: string, kind: string, value: string, extra: string>"
CLAIM = f"struct<prop: string, kind: string, value: string, extra: string, quals: array<{QUAL}>, place: struct<city: string, region: string, country: string>, repeat: boolean>"
DRAFT = ["rank", "tbl", "row", "space", "name", "always", "key", "kind", "label", "description", "cls", "first_only", "claims", "more", "used", "counted"]


def key_of(kind: str | Column, ident: Column) -> Column:
    return F.concat_ws(":", F.lit("reg"), kind if isinstance(kind, Column) else F.lit(kind), ident)


def slug_of(c: Column) -> Column:
    s = F.regexp_replace(F.left(F.replace(fold(c), F.lit(" "), F.lit("-")), F.lit(80)), "-+$", "")
    return F.when(s != "", s).otherwise("x")


def blank(c: Column) -> Column:
    return clean_blank(collapse(c.cast("string")))


def year(c: Column) -> Column:
    y = F.regexp_extract(c, r"\b(1[6-9]\d\d|20\d\d)\b", 1)
    return F.when(y != "", y)


def website(c: Column) -> Column:
    """A link that isn't an address of mail or Instagram; https is put before a bare host."""
    t, linked = c, c.rlike("^https?://")
    ok = ~F.contains(t, F.lit(" ")) & ~(F.contains(t, F.lit("@")) & ~t.startswith("http")) & ~F.contains(t, F.lit("instagram.com")) & (linked | F.contains(t, F.lit(".")))
    return F.when(ok, F.left(F.when(linked, t).otherwise(F.concat(F.lit("https://"), t)), F.lit(500)))


def instagram(c: Column) -> Column:
    t = c
    link = F.regexp_extract(t, r"instagram\.com/([A-Za-z0-9_.]{2,30})", 1)
    bare = F.when(t.rlike(r"^@[A-Za-z0-9_.]{2,30}$"), F.rtrim(F.substring(t, 2, 30), F.lit("."))).when(t.rlike(r"^[A-Za-z0-9_.]{2,30}$") & ~F.contains(F.trim(t, F.lit(".")), F.lit(".")), t)
    return F.when(link != "", F.rtrim(link, F.lit("."))).otherwise(bare)


def url_value(c: Column) -> Column:
    """A link with spaces collapsed and every character that a URL can't have percent-encoded, at most 2,000 characters."""
    coded = lambda x: F.when(x.rlike(r"[A-Za-z0-9:/?#@!$&'()*+,;=%._~-]"), x).when(x == " ", "%20").otherwise(F.url_encode(x))
    return F.left(F.array_join(F.transform(F.split(collapse(c), ""), coded), ""), F.lit(2000))


def when(c: Column) -> Column:
    """struct<value, extra> of a date that begins a text: extra is its precision, 9 for a year, 10 for a month, 11 for a day."""
    t = F.trim(c)
    y, m, d = (F.regexp_extract(t, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", i) for i in (1, 2, 3))
    two = lambda x: F.lpad(x, 2, "0")
    value = F.when((m != "") & (d != ""), F.concat_ws("-", y, two(m), two(d))).when(m != "", F.concat(y, F.lit("-"), two(m), F.lit("-00"))).otherwise(F.concat(y, F.lit("-00-00")))
    extra = F.when((m != "") & (d != ""), "11").when(m != "", "10").otherwise("9")
    return F.when((y != "") & y.try_cast("int").between(1000, 2100), F.struct(value.alias("value"), extra.alias("extra")))


def claim(prop: str | Column, kind: str, value: Column, extra: Column | None = None, quals: list[Column] | None = None, place: Column | None = None, repeat: bool = False) -> Column:
    """A CLAIM, null where its value is. kinds: item, string, url, ext, mono, quantity, time, coordinate; and still to be resolved: person
    and studio (a name), place, country, and term:<kind> (words of a vocabulary)."""
    held = place if place is not None else value
    none = F.lit(None)
    all_quals = F.array_compact(F.array(*quals)).cast(f"array<{QUAL}>") if quals else F.array().cast(f"array<{QUAL}>")
    fields = [(prop if isinstance(prop, Column) else F.lit(prop)).alias("prop"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), (extra if extra is not None else none).cast("string").alias("extra"), all_quals.alias("quals"), (place if place is not None else none).cast("struct<city: string, region: string, country: string>").alias("place"), F.lit(repeat).alias("repeat")]
    return F.when(held.isNotNull(), F.struct(*fields))


def qual(prop: str, kind: str, value: Column, extra: Column | None = None) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(prop).alias("prop"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), (extra if extra is not None else F.lit(None)).cast("string").alias("extra")))


def dated(prop: str, c: Column, quals: bool = False) -> Column:
    t = when(c)
    return qual(prop, "time", t["value"], t["extra"]) if quals else claim(prop, "time", t["value"], t["extra"])


def gathered(*claims: Column | list[Column]) -> Column:
    """One array of claims out of single ones and arrays of them (each in a list)."""
    empty = F.array().cast(f"array<{CLAIM}>")
    return F.array_compact(F.flatten(F.array(*[F.coalesce(c[0].cast(f"array<{CLAIM}>"), empty) if isinstance(c, list) else F.array(c).cast(f"array<{CLAIM}>") for c in claims])))


def public_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HOUSEKEEPING and not c.startswith("_") and not is_private(c)]


def picked(df: DataFrame, **meanings: str | list[str]) -> DataFrame:
    """df with p_<name>, the first filled column of a meaning by name, then the first whose name contains one of its words; and u_<name>, which
    column that was. Only public columns are looked at."""
    public, out = public_of(df), {}
    for name, meaning in meanings.items():
        words = COLUMNS[meaning] if isinstance(meaning, str) else meaning
        found = [c for c in words if c in public] + [c for c in public if c not in words and any(w in c for w in words)]
        out[f"p_{name}"] = F.coalesce(*[blank(F.col(c)) for c in found]) if found else F.lit(None).cast("string")
        out[f"u_{name}"] = F.coalesce(*[F.when(blank(F.col(c)).isNotNull(), F.lit(c)) for c in found]) if found else F.lit(None).cast("string")
    return df.withColumns(out)


P = lambda name: F.col(f"p_{name}")


def _used(df: DataFrame, first: str) -> Column:
    """The columns that a row used: all picked ones, or the first alone where the row was put aside by its name."""
    every = [c for c in df.columns if c.startswith("u_")]
    return F.array_compact(F.when(F.col("good"), F.array(*every)).otherwise(F.array(f"u_{first}")))


def _draft(df: DataFrame, rank: int, tbl: str, key: Column, kind: str, label: Column, description: Column, cls: Column, claims: Column | None, used: Column | None = None, space: str | None = None, always: bool = True, first_only: bool = False, more: Column | None = None, counted: bool = True, row: Column | None = None) -> DataFrame:
    """Rows that aren't good (a column of df) keep what they used, without an item."""
    empty, good = F.array().cast(f"array<{CLAIM}>"), F.col("good")
    only = lambda c: F.when(good, c)
    held = lambda c: F.coalesce(only(c), empty) if c is not None else empty
    return df.select(
        F.lit(rank).alias("rank"), F.lit(tbl).alias("tbl"), (row if row is not None else F.col("_row_id")).cast("string").alias("row"), F.lit(space).cast("string").alias("space"), (only(fold_exact(label)) if space else F.lit(None).cast("string")).alias("name"), F.lit(always).alias("always"),
        only(key).alias("key"), F.lit(kind).alias("kind"), only(clip(label, 250)).alias("label"), only(clip(description, 250)).alias("description"), only(cls).alias("cls"), F.lit(first_only).alias("first_only"),
        held(claims).alias("claims"), held(more).alias("more"), (used if used is not None else F.array().cast("array<string>")).alias("used"), F.lit(counted).alias("counted"),
    )


def _words(kind: str, prop: str, c: Column, ordinal: str | None = None) -> Column:
    """A claim of words that a vocabulary resolves part by part, later."""
    return claim(prop, f"term:{kind}", c, quals=[qual("series ordinal", "string", F.lit(ordinal))] if ordinal else None)


def _linked(df: DataFrame) -> DataFrame:
    """p_web and p_instagram as the values of their claims."""
    df = df.withColumns({k: v for k, v in (("p_web", website(P("web"))), ("p_instagram", instagram(P("instagram")) if "p_instagram" in df.columns else None)) if v is not None})
    return df.withColumn("p_web", url_value(P("web")))


_PERSON = {"based": "based", "roles": "roles", "web": "web", "instagram": "instagram", "technique": "technique", "technique2": "technique2", "technique3": "technique3"}


def _person(df: DataFrame, **names: str) -> DataFrame:
    """df with what a row says of a person: p_<name> of names, links, `place` and p_where."""
    df = _linked(picked(df, **names, **_PERSON))
    df = with_place(df, "place", None, None, None, P("based"))
    p = F.col("place")
    where = F.concat_ws(", ", F.nullif(p["city"], F.lit("")), F.coalesce(F.nullif(p["region"], F.lit("")), F.nullif(p["country"], F.lit(""))))
    return df.withColumn("p_where", where).withColumn("p_where", F.when(P("based").isNotNull(), F.coalesce(F.nullif(P("where"), F.lit("")), P("based")))).withColumn("good", looks_like_name(P(next(iter(names)))))


def _person_claims() -> Column:
    return gathered(
        claim("occupation", "item", key_of("occupation", F.lit("glass-artist"))), _words("occupation", "occupation", P("roles")), claim("work location", "place", F.lit(None), place=F.col("place")), claim("official website", "url", P("web")),
        claim("Instagram username", "ext", P("instagram")), *(_words("technique", "technique", P(f"technique{n or ''}"), n) for n in (None, "2", "3")),
    )


def _told(what: Column, where: Column, between: str) -> Column:
    return F.when(where.isNotNull(), F.concat(what, F.lit(between), where)).otherwise(what)


def _class(name: str) -> Column:
    return key_of("class", F.lit(name))


def people(df: DataFrame, tbl: str, rank: int) -> DataFrame:
    df = _person(df, name="name")
    return _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "person", P("name"), _told(F.lit(WORDS["person"]), P("where"), ", "), _class("person"), _person_claims(), _used(df, "name"), "person")


def museum_artists(df: DataFrame, rank: int) -> list[DataFrame]:
    """People in collections: a known person gains a claim, an unknown one is made; and the museums."""
    df = _person(df, name="held", museum="museum")
    museum = key_of("museum", slug_of(P("museum")))
    made = _draft(df, rank, "museum_artists", key_of("museum_artists", F.col("_row_id")), "person", P("name"), F.lit(WORDS["held"]), _class("person"), _person_claims(), _used(df, "name"), "person", always=False, more=gathered(claim("collection", "item", F.when(P("museum").isNotNull(), museum))))
    houses = df.withColumn("good", F.col("good") & P("museum").isNotNull())
    return [made, _draft(houses, rank, "museum_artists", museum, "museum", P("museum"), F.lit(WORDS["museum"]), _class("museum"), None, first_only=True, counted=False)]


def awarded(df: DataFrame, tbl: str, rank: int, award: str) -> list[DataFrame]:
    """People with an award of the table, and the award itself."""
    df = _person(df, name="recipient", year="year")
    key = key_of("award", slug_of(F.lit(award)))
    given = gathered(claim("award received", "item", key, quals=[dated("point in time", year(P("year")), True)]))
    made = _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "person", P("name"), F.lit(WORDS["awarded"]), _class("person"), _person_claims(), _used(df, "name"), "person", always=False, more=given)
    return [made, _draft(df.withColumn("good", F.lit(True)), rank, tbl, key, "award", F.lit(award), F.lit("award"), _class("award"), None, first_only=True, counted=False)]


def studio_class(kind: Column) -> Column:
    t = fold(kind)
    return F.coalesce(*[F.when(F.contains(t, F.lit(w)), c) for w, c in STUDIO_CLASSES], F.lit("studio"))


def studios(df: DataFrame, tbl: str, rank: int) -> DataFrame:
    df = picked(df, name="studio", city="city", region="region", country="country", type="type", lat="lat", lng="lng", founded="founded", web="web", instagram="instagram")
    df = with_place(_linked(df), "place", P("city"), P("region"), P("country"))
    df = df.withColumns({"known": country_label(P("country")), "p_type": F.lower(P("type")), "x": P("lat").try_cast("double"), "y": P("lng").try_cast("double"), "local": P("city").isNotNull() | P("region").isNotNull(), "good": looks_like_name(P("name"))})
    df = df.withColumns({"land": F.coalesce("known", P("country")), "shop": studio_class(P("type"))})
    inland = F.when(F.col("land").isNull() | (F.col("land") == "United States"), F.nullif(F.col("place")["region"], F.lit("")))
    df = df.withColumn("p_where", F.concat_ws(", ", P("city"), F.coalesce(inland, "land")))
    what = F.when((F.length(P("type")) < 40) & ~P("type").isin("studio", "other", "mixed"), P("type")).otherwise(WORDS["studio"])
    x, y = F.col("x"), F.col("y")
    ok = x.between(-90, 90) & y.between(-180, 180) & ((x != 0) | (y != 0))
    claims = gathered(
        claim("instance of", "item", F.when(F.col("shop") != "studio", _class("studio"))), claim(F.when(F.col("local"), "located in").otherwise("country"), "place", F.lit(None), place=F.col("place")), claim("country", "country", F.when(F.col("local"), F.col("known"))),
        claim("coordinates", "coordinate", F.when(ok, F.format_string("%.5f,%.5f", x, y))), dated("inception", year(P("founded"))), claim("official website", "url", P("web")), claim("Instagram username", "ext", P("instagram")),
    )
    return _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "studio", P("name"), _told(what, F.nullif(P("where"), F.lit("")), " in "), key_of("class", F.col("shop")), claims, _used(df, "name"), "studio")


def schools(df: DataFrame, tbl: str, rank: int) -> list[DataFrame]:
    df = with_place(_linked(picked(df, name="institution", program="program", city="city", region="region", country="country", web="web")), "place", P("city"), P("region"), P("country"))
    df = df.withColumns({"good": looks_like_name(P("name")), "key": key_of("school", slug_of(P("name")))})
    link = claim("official website", "url", P("web"))
    located = claim(F.when(P("city").isNotNull() | P("region").isNotNull(), "located in").otherwise("country"), "place", F.lit(None), place=F.col("place"))
    own = _draft(df, rank, tbl, F.col("key"), "school", P("name"), F.lit(WORDS["school"]), _class("school"), gathered(located, link), _used(df, "name"), first_only=True)
    parts = df.withColumn("good", F.col("good") & P("program").isNotNull() & (fold(P("program")) != fold(P("name"))))
    return [own, _draft(parts, rank + 1, tbl, key_of(tbl, F.col("_row_id")), "program", P("program"), F.concat(F.lit("glass program at "), P("name")), _class("program"), gathered(claim("part of", "item", F.col("key")), link))]


def funders(df: DataFrame, tbl: str, rank: int) -> DataFrame:
    df = _linked(picked(df, name="funder", type="type", web="web")).withColumn("good", looks_like_name(P("name")))
    told = F.when(F.length(P("type")) < 60, F.concat(F.lower(P("type")), F.lit(" funding work in glass"))).otherwise(WORDS["funder"])
    return _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "funder", P("name"), told, _class("funder"), gathered(claim("official website", "url", P("web"))), _used(df, "name"))


def shows(df: DataFrame, tbl: str, rank: int, cls: str = "show", what: str = "show or open call") -> DataFrame:
    df = _linked(picked(df, name="show", city=COLUMNS["city"] + ["location", "where"], region="region", country="country", start="start", end="end", web="web"))
    alone = P("city").isNotNull() & P("region").isNull() & P("country").isNull()
    df = with_place(df, "place", F.when(~alone, P("city")), P("region"), P("country"), F.when(alone, P("city"))).withColumn("good", looks_like_name(P("name")))
    claims = gathered(dated("start time", P("start")), dated("end time", P("end")), claim("located in", "place", F.lit(None), place=F.col("place")), claim("official website", "url", P("web")))
    return _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "show", P("name"), _told(F.lit(what), P("city"), " in "), _class(cls), claims, _used(df, "name"))


def hosted_shows(df: DataFrame, tbl: str, rank: int) -> DataFrame:
    """Shows that makers host: those listed and not a draft, with the studio as a participant and the form of what is shown."""
    names = ("title", "host_name", "studio", "venue", "city", "region", "country", "starts", "ends", "piece_type")
    df = df.where("listing = 'approved' AND status <> 'draft'").withColumns({f"p_{k}": blank(F.col(k)) for k in names})
    df = with_place(df, "place", P("city"), P("region"), P("country")).withColumns({"good": P("title").isNotNull(), "y": year(P("starts"))})
    told = F.concat_ws(" ", F.concat(F.lit("show or sale by "), F.coalesce(P("host_name"), P("studio"), F.lit("a maker"))), F.concat(F.lit("at "), P("venue")), F.concat(F.lit("in "), P("city")))
    claims = gathered(dated("start time", P("starts")), dated("end time", P("ends")), claim("located in", "place", F.lit(None), place=F.col("place")), claim("participant", "studio", F.coalesce(P("studio"), P("host_name"))), claim("form", "form", F.concat_ws(" ", P("piece_type"), P("title"))))
    used = F.array_compact(F.array(*[F.when(P(k).isNotNull() & F.col("good"), F.lit(k)) for k in names]))
    return _draft(df, rank, tbl, key_of(tbl, F.col("_row_id")), "show", _told(P("title"), F.concat(F.lit("("), F.col("y"), F.lit(")")), " "), told, _class("show"), claims, used)


def season_results(seasons: DataFrame, entries: DataFrame, votes: DataFrame) -> DataFrame:
    """entry_id, object_id, season, season_title, studio, edition_size, rank, won, starts, closes, votes of the approved entries of seasons
    that aren't drafts.

    seasons: id, title, status, starts, ends, voting_closes. entries: id, season_id, object_row_id, studio, edition_size, created_at, status.
    votes: entry_id. Entries are ranked by votes, then time, then id; the rank shows once the season is closed, and the first has won if
    it has a vote.
    """
    counted = entries.where("status = 'approved'").join(votes.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("votes")), "id", "left").fillna(0, ["votes"])
    s = seasons.where("status <> 'draft'").select(F.col("id").alias("season_id"), F.col("title").alias("season_title"), "starts", F.coalesce(F.nullif(F.col("voting_closes").cast("string"), F.lit("")), F.col("ends").cast("string")).alias("closes"), (F.col("status") == "closed").alias("closed"))
    place = F.row_number().over(Window.partitionBy("season_id").orderBy(F.desc("votes"), F.asc_nulls_first("created_at"), "id"))
    out = counted.join(s, "season_id").withColumn("n", place)
    return out.select(
        F.col("id").alias("entry_id"), F.col("object_row_id").cast("string").alias("object_id"), key_of("seasons", F.col("season_id").cast("string")).alias("season"), "season_title", "studio", "edition_size",
        F.when(F.col("closed"), F.col("n")).alias("rank"), (F.col("closed") & (F.col("n") == 1) & (F.col("votes") > 0)).alias("won"), F.col("starts").cast("string").alias("starts"), "closes", "votes",
    )


def seasons(df: DataFrame, rank: int) -> DataFrame:
    df = df.where("status <> 'draft'")
    used = F.array(*map(F.lit, ("title", "theme", "starts", "ends", "status")))
    claims = [dated(p, F.col(c).cast("string")) for p, c in (("start time", "starts"), ("end time", "ends"))]
    label = F.coalesce(blank(F.col("title")), blank(F.col("slug")), F.lit(WORDS["season"]))
    df = df.withColumn("good", F.lit(True))
    return _draft(df, rank, "seasons", key_of("seasons", F.col("id").cast("string")), "season", label, F.coalesce(blank(F.col("theme")), F.lit(WORDS["season"])), _class("season"), gathered(*claims), used, row=F.col("id"))


SIZES = r"(?i)^\s*([\d.]+)\s*[×x*]\s*([\d.]+)\s*[×x*]\s*([\d.]+)\s*mm"


def objects(df: DataFrame, rank: int, results: DataFrame | None) -> list[DataFrame]:
    """Pieces with maker, techniques, form, colour, size, hash, story and their entries.

    df: _row_id, title, maker, year, techniques, dimensions, content_hash, colour, rating, events (array of event_type, event_date,
    actor, location; null for none). results: an answer of `season_results`.
    """
    if results is not None:
        each = results.groupBy(F.col("object_id").alias("_row_id")).agg(F.array_sort(F.collect_list(F.struct("entry_id", "season", "season_title", "studio", "edition_size", "rank", "won", "starts", "closes"))).alias("entries"))
        df = df.withColumn("_row_id", F.col("_row_id").cast("string")).join(each, "_row_id", "left")
    else:
        df = df.withColumn("entries", F.lit(None).cast("array<struct<entry_id: bigint, season: string, season_title: string, studio: string, edition_size: int, rank: int, won: boolean, starts: string, closes: string>>"))
    df = df.withColumns({"p_title": F.coalesce(blank(F.col("title")), F.lit("Untitled piece")), "p_maker": blank(F.col("maker")), "y": year(F.col("year").cast("string")), "p_techniques": blank(F.col("techniques")), "p_hash": blank(F.col("content_hash")), "good": F.lit(True)})
    title, maker, y = P("title"), P("maker"), F.col("y")
    size = [F.nullif(F.regexp_extract("dimensions", SIZES, i), F.lit("")) for i in (1, 2, 3)]
    themes = F.array_join(F.transform("entries", lambda e: F.coalesce(e["season_title"], F.lit(""))), " ")
    entries = F.transform("entries", lambda e: claim("participant in", "item", e["season"], quals=[dated("point in time", e["starts"], True), qual("series ordinal", "string", e["rank"])]))
    first_size = F.get(F.filter("entries", lambda e: e["edition_size"] != 0), 0)["edition_size"]
    made_at = F.transform("entries", lambda e: claim("made at", "studio", blank(e["studio"])))
    won = F.transform(F.filter("entries", lambda e: e["won"]), lambda e: claim("award received", "item", key_of("award", F.lit("crowd-favourite")), quals=[dated("point in time", e["closes"], True)]))
    story = F.transform("events", lambda e: claim("story event", "term:event-type", F.coalesce(e["event_type"], F.lit("other")), quals=[dated("point in time", e["event_date"], True), qual("subject named as", "string", clip(blank(e["actor"]), 400)), qual("location", "studio", blank(e["location"]))], repeat=True))
    key = key_of("object", F.coalesce(P("hash"), F.col("_row_id").cast("string")))
    claims = [
        claim("title", "mono", title, F.lit("en")), claim("maker", "person", maker), dated("inception", y), _words("technique", "technique", P("techniques")), claim("form", "form", F.concat_ws(" ", title, P("techniques"), themes)),
        claim("colour", "term:colour", blank(F.col("colour")), quals=[qual("determination method", "item", key_of("event-type", F.lit("verified")))]), *(claim(p, "quantity", s, key_of("unit", F.lit("mm"))) for p, s in zip(("width", "depth", "height"), size, strict=True)),
        claim("content hash", "string", P("hash")), claim("strength", "quantity", F.col("rating").cast("string").try_cast("double").cast("long")), [story], [entries], claim("edition size", "quantity", first_size), [made_at], [won],
    ]
    told = F.when(maker.isNotNull(), F.concat_ws(", ", F.concat(F.lit(WORDS["object"] + " by "), maker), y)).otherwise(F.concat_ws(", ", F.lit(WORDS["object"]), y))
    named = ("title", "maker", "year", "techniques", "dimensions", "content_hash")
    used = F.array_compact(F.array(*[F.when(blank(F.col(c)).isNotNull(), F.lit(c)) for c in named]))
    own = _draft(df, rank, "objects", key, "object", title, told, _class("object"), gathered(*claims), used)
    makers = _draft(df.withColumn("good", maker.isNotNull()), rank, "objects", key_of("maker", slug_of(maker)), "person", maker, F.lit(WORDS["maker"]), _class("person"), gathered(claim("occupation", "item", key_of("occupation", F.lit("glass-artist")))), None, "person", always=False, counted=False)
    shops = df.select("_row_id", F.explode("entries").alias("e")).select("_row_id", blank(F.col("e.studio")).alias("s")).withColumn("good", looks_like_name(F.col("s")))
    made = _draft(shops, rank, "season_entries", key_of("studio", slug_of(F.col("s"))), "studio", F.col("s"), F.lit(WORDS["studio"]), _class("studio"), None, None, "studio", always=False, counted=False)
    won = df.where(F.exists("entries", lambda e: e["won"]))
    award = _draft(won, rank, "seasons", key_of("award", F.lit("crowd-favourite")), "award", F.lit("Crowd Favourite"), F.lit("people's choice of a collecting event"), _class("award"), None, first_only=True, counted=False)
    return [own, makers, made, award]


def lineage_links(rows: DataFrame, people: DataFrame, studios: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims: key, prop, kind, value, extra, quals, row; held: row, student, mentor, relation, years, where_, why) of who learnt from whom.

    rows: _row_id and columns for student, mentor, relation, years, where. people, studios: name (folded), key. Each row gives a claim
    either way; the student's also has the place, if it is a known studio. A row with an end that nobody is known by is held, with the
    reason; hand held rows in again when more people are known, in whatever order they come. Rows without two different names are
    left out, and a row that comes again under its id counts once.
    """
    names = {"student": "student", "mentor": "mentor", "relation": "relation", "years": "years", "where_": "where"}
    own = picked(rows, **names).select(F.col("_row_id").cast("string").alias("row"), *(P(k).alias(k) for k in names))
    if held is not None:
        own = own.unionByName(held.select(*own.columns))
    own = own.where(looks_like_name(F.col("student")) & looks_like_name(F.col("mentor"))).withColumns({"s": fold_exact(F.col("student")), "m": fold_exact(F.col("mentor")), "w": fold_exact(F.col("where_"))}).where("s <> m").dropDuplicates(["row"])
    key = lambda df, c, to: df.select(F.col("name").alias(c), F.col("key").alias(to))
    own = own.join(key(people, "s", "student_key"), "s", "left").join(key(people, "m", "mentor_key"), "m", "left").join(key(studios, "w", "studio_key"), "w", "left")
    why = F.when(F.col("student_key").isNull(), F.concat(F.lit("student not found: "), "student")).when(F.col("mentor_key").isNull(), F.concat(F.lit("mentor not found: "), "mentor"))
    own = own.withColumn("why", why)
    years = F.regexp_extract_all("years", F.lit(r"\b(1[89]\d\d|20\d\d)\b"), 1)
    common = [qual("subject named as", "string", F.col("relation")), dated("start time", F.get(years, 0), True), F.when(F.size(years) > 1, dated("end time", F.element_at(years, -1), True))]
    put = lambda key, prop, value, quals: F.struct(key.alias("key"), F.lit(prop).alias("prop"), F.lit("item").alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("extra"), F.array_compact(F.array(*quals)).cast(f"array<{QUAL}>").alias("quals"))
    links = own.where("why IS NULL").select("row", F.explode(F.array(put(F.col("student_key"), "student of", F.col("mentor_key"), [*common, qual("location", "item", F.col("studio_key"))]), put(F.col("mentor_key"), "student", F.col("student_key"), common))).alias("c"))
    return links.select("c.*", "row"), own.where("why IS NOT NULL").select("row", "student", "mentor", "relation", "years", "where_", "why")


@dataclass
class Staged:
    """items: key, kind, label, description, cls, tbl, row. claims: key, n, prop, kind, value, extra, quals. report: tbl, rows, items, used,
    ignored. held: rows of lineage. unknown: kind, part, n, the words without a term. people, studios: name, key."""

    items: DataFrame
    claims: DataFrame
    report: DataFrame
    held: DataFrame
    unknown: DataFrame
    people: DataFrame
    studios: DataFrame
    parts: dict[str, DataFrame] = field(default_factory=dict)


#: How each table is read, in order of rank; further arguments of the source.
SOURCES: list[tuple[str, Callable, int, tuple]] = [
    ("artists", people, 0, ()), ("profiles", people, 1, ()), ("artist_submissions", people, 2, ()), ("artists_legacy", people, 3, ()),
    ("studios", studios, 10, ()), ("studio_submissions", studios, 11, ()), ("studios_directory_legacy", studios, 12, ()),
    ("university_programs", schools, 20, ()), ("programs", schools, 22, ()), ("funding", funders, 24, ()), ("maker_events", hosted_shows, 30, ()),
    *((t, shows, 31 + i, a) for i, (t, *a) in enumerate((("events", "show", "show or open call"), ("open_calls", "show", "show or open call"), ("trade_craft_retail", "trade-fair", "trade show"), ("trade_wholesale", "trade-fair", "trade show"), ("trade_interior_arch", "trade-fair", "trade show"), ("art_fairs", "art-fair", "art fair")))),
]


def stage(tables: dict[str, DataFrame], vocab: DataFrame, forms: dict[str, str] | None = None, award: str = "Annual Commission") -> Staged:
    """All items and claims of the tables that are there (each with its approved rows alone, `_row_id` its id).

    Beside those of SOURCES: museum_artists, commissions (recipients of `award`), seasons with season_entries and season_votes, objects, and
    lineage_submissions. vocab: kind, id, label, description, alternatives, old, the fixed terms, which become items too. forms: words
    of titles that stand for a form. Private columns are never read; columns left over are in the report. Items of one key are
    one: the first gives label and description, claims come together. Claims whose words nobody knows are left out and counted.
    """
    drafts: list[DataFrame] = []
    for tbl, source, rank, more in SOURCES:
        if tbl in tables:
            made = source(tables[tbl], tbl, rank, *more)
            drafts += made if isinstance(made, list) else [made]
    if "museum_artists" in tables:
        drafts += museum_artists(tables["museum_artists"], 4)
    if "commissions" in tables:
        drafts += awarded(tables["commissions"], "commissions", 5, award)
    results = None
    if "seasons" in tables:
        drafts.append(seasons(tables["seasons"], 40))
        if "season_entries" in tables:
            results = season_results(tables["seasons"], tables["season_entries"], tables["season_votes"])
    if "objects" in tables:
        drafts += objects(tables["objects"], 41, results)
    every = cut(reduce(DataFrame.unionByName, [d.select(*DRAFT) for d in drafts]))

    first = F.min(F.struct("rank", "row", "key"))
    known = every.where("name IS NOT NULL AND key IS NOT NULL").groupBy("space", "name").agg(first.alias("f")).select("space", "name", F.col("f.key").alias("winner"), F.col("f.rank").alias("winner_rank"), F.col("f.row").alias("winner_row"))
    every = every.join(known, ["space", "name"], "left")
    made = F.col("key").isNotNull() & (F.col("always") | ((F.col("winner") == F.col("key")) & (F.col("winner_rank") == F.col("rank")) & F.col("winner_row").eqNullSafe(F.col("row"))))
    every = cut(every.withColumn("made", made))

    by_key = every.where("made").groupBy("key").agg(F.min(F.struct("rank", "row", "kind", "label", "description", "cls", "tbl")).alias("f"), F.min(F.when(F.col("description") != "", F.struct("rank", "row", "description"))).alias("d"))
    items = by_key.select("key", "f.kind", "f.label", F.coalesce("d.description", F.lit("")).alias("description"), "f.cls", "f.tbl", "f.row")
    firsts = by_key.select("key", F.col("f.rank").alias("first_rank"), F.col("f.row").alias("first_row"))
    own = every.where("made AND size(claims) > 0").join(firsts, "key").where("NOT first_only OR (first_rank = rank AND first_row <=> row)").select("key", "rank", "row", F.lit(0).alias("part"), F.posexplode("claims").alias("n", "c"))
    more = every.where("winner IS NOT NULL AND key IS NOT NULL AND size(more) > 0").select(F.col("winner").alias("key"), "rank", "row", F.lit(1).alias("part"), F.posexplode("more").alias("n", "c"))
    raw = cut(own.unionByName(more).select("key", "rank", "row", "part", "n", "c.*"))
    persons, shops = (known.where(F.col("space") == s).select("name", F.col("winner").alias("key")) for s in ("person", "studio"))

    resolved, unknown = _resolve(raw, persons, shops, vocab, forms or {})
    places, place_claims = _places(raw)
    terms, term_claims = _terms(vocab)
    linked, held, lineage = [], None, tables.get("lineage_submissions")
    if lineage is not None:
        links, held = lineage_links(lineage, persons, shops)
        linked = [links.select("key", F.lit(90).alias("rank"), "row", F.lit(0).alias("part"), F.lit(0).alias("n"), "prop", "kind", "value", "extra", "quals", F.lit(False).alias("repeat"))]
    claims = reduce(DataFrame.unionByName, [resolved, place_claims, term_claims, *linked])
    same = [F.when(F.col("repeat"), F.concat_ws("|", "row", "n")), "prop", "kind", "value", "extra", "quals"]
    told = claims.groupBy("key", *[c if isinstance(c, str) else c.alias("_apart") for c in same]).agg(F.min(F.struct("rank", "row", "part", "n")).alias("o"))
    claims = told.select("key", F.row_number().over(Window.partitionBy("key").orderBy("o", "prop", "value", F.to_json("quals"))).alias("n"), "prop", "kind", "value", "extra", "quals")
    countries = _countries(raw, places)
    items = items.unionByName(places).unionByName(countries.join(terms.select("key"), "key", "left_anti")).unionByName(terms)
    return Staged(items, claims, stage_report(every, tables, lineage), held, unknown, persons, shops, {"results": results})


def _resolve(raw: DataFrame, people: DataFrame, studios: DataFrame, vocab: DataFrame, forms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Claims with every word turned into an item's key, and the words that no vocabulary has."""
    cols = ["key", "rank", "row", "part", "n", "prop", "kind", "value", "extra", "quals", "repeat"]
    # Studios named in qualifiers: one lookup of the few distinct names, then a map in each claim would grow; so qualifiers are joined one by one.
    loc = F.get(F.filter("quals", lambda q: q["kind"] == "studio"), 0)["value"]
    with_loc = raw.withColumn("_loc", fold_exact(loc)).join(studios.select(F.col("name").alias("_loc"), F.col("key").alias("_at")), "_loc", "left")
    put = F.transform("quals", lambda q: F.when(q["kind"] != "studio", q).when(F.col("_at").isNotNull(), F.struct(q["prop"].alias("prop"), F.lit("item").alias("kind"), F.col("_at").alias("value"), F.lit(None).cast("string").alias("extra"))))
    raw = with_loc.withColumn("quals", F.array_compact(put))
    done = raw.where("kind NOT IN ('person', 'studio', 'place', 'country', 'form') AND NOT startswith(kind, 'term:')")
    out = [done.select(*cols)]
    for kind, names in (("person", people), ("studio", studios)):
        named = raw.where(F.col("kind") == kind).withColumn("_f", fold_exact(F.col("value"))).join(names.select(F.col("name").alias("_f"), F.col("key").alias("_k")), "_f")
        out.append(named.withColumns({"value": F.col("_k"), "kind": F.lit("item")}).select(*cols))
    item = lambda df, value: df.withColumns({"value": value, "kind": F.lit("item")}).select(*cols)
    out.append(item(raw.where("kind = 'place'"), place_key(F.col("place"))))
    out.append(item(raw.where("kind = 'country'"), key_of("country", slug_of(F.col("value")))))
    if forms:
        known = F.create_map(*(F.lit(x) for kv in forms.items() for x in kv))
        found = F.slice(F.array_distinct(F.array_compact(F.transform(F.split(fold(F.col("value")), r"[^a-z]+"), lambda w: F.try_element_at(known, w)))), 1, 2)
        each = raw.where("kind = 'form'").select("*", F.posexplode(found).alias("_n", "_w")).withColumn("n", F.col("n") + F.col("_n"))
        out.append(item(each, key_of("form", F.col("_w"))))
    words = raw.where("startswith(kind, 'term:')").withColumn("_kind", F.substring("kind", 6, 100)).withColumn("_id", F.struct("key", "rank", "row", "part", "n"))
    unknown = []
    kinds = [r.kind for r in vocab.select("kind").distinct().collect()]
    for kind in ("technique", "occupation", "colour", "event-type"):
        own = words.where(F.col("_kind") == kind)
        if kind not in kinds:
            continue
        terms = vocabulary(vocab.where(F.col("kind") == kind).select(*[F.col(c) for c in ("id", "label", "alternatives", "old")]))
        exact = kind != "technique"
        found = resolve_terms(own.select("_id", "value"), "_id", "value", terms, inside=not exact)
        hits = own.join(found.select("_id", F.col("n").alias("_n"), "term_id"), "_id").withColumn("n", F.col("n") + F.least("_n", F.lit(999)))
        if kind == "event-type":
            hits = hits.withColumn("term_id", F.coalesce("term_id", F.lit("other")))
        out.append(item(hits.where("term_id IS NOT NULL"), key_of(kind, F.col("term_id"))))
        unknown.append(found.where("term_id IS NULL").groupBy("part").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "part", "n"))
    spare = raw.limit(0).select(F.lit("").alias("kind"), F.lit("").alias("part"), F.lit(0).cast("bigint").alias("n"))
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, unknown, spare)


def place_key(p: Column) -> Column:
    """The key of a place struct: a country's where it is all that is known."""
    label = F.coalesce(F.nullif(p["city"], F.lit("")), p["region"])
    tail = F.when((p["city"] != "") & (p["region"] != ""), p["region"]).otherwise(p["country"])
    return F.when((p["city"] == "") & (p["region"] == ""), key_of("country", slug_of(p["country"]))).otherwise(key_of("place", slug_of(F.trim(F.concat_ws(" ", label, tail)))))


def _places(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places that claims name, and the regions they lie in, once each."""
    named = raw.where("place IS NOT NULL").groupBy("place").agg(F.min(F.struct("rank", "row", "n")).alias("o"))
    region = named.where("place.city <> '' AND place.region <> ''").select(F.struct(F.lit("").alias("city"), "place.region", "place.country").alias("place"), "o")
    both = named.withColumn("level", F.lit(0)).unionByName(region.withColumn("level", F.lit(1))).where("place.city <> '' OR place.region <> ''")
    one = both.withColumn("key", place_key(F.col("place"))).groupBy("key").agg(F.min(F.struct("o", "level", "place")).alias("f")).select("key", "f.place")
    p = F.col("place")
    told = F.concat_ws(", ", F.when(p["city"] != "", F.nullif(p["region"], F.lit(""))), F.nullif(p["country"], F.lit("")))
    items = one.select("key", F.lit("place").alias("kind"), F.coalesce(F.nullif(p["city"], F.lit("")), p["region"]).alias("label"), F.when(told != "", told).otherwise("place").alias("description"), key_of("class", F.lit("place")).alias("cls"), F.lit("places").alias("tbl"), F.lit(None).cast("string").alias("row"))
    up = F.struct(F.lit("").alias("city"), p["region"].alias("region"), p["country"].alias("country"))
    put = lambda prop, value: F.struct(F.lit(prop).alias("prop"), value.alias("value"))
    each = F.array_compact(F.array(F.when(p["country"] != "", put("country", key_of("country", slug_of(p["country"])))), F.when((p["city"] != "") & (p["region"] != ""), put("located in", place_key(up)))))
    claims = one.select("key", F.lit(80).alias("rank"), F.lit("").alias("row"), F.lit(0).alias("part"), F.posexplode(each).alias("n", "c"))
    return items, claims.select("key", "rank", "row", "part", "n", "c.prop", F.lit("item").alias("kind"), "c.value", F.lit(None).cast("string").alias("extra"), F.array().cast(f"array<{QUAL}>").alias("quals"), F.lit(False).alias("repeat"))


def _countries(raw: DataFrame, places: DataFrame) -> DataFrame:
    """Countries that places or claims name."""
    labels = raw.where("place IS NOT NULL").select(F.col("place.country").alias("label")).unionAll(raw.where("kind = 'country'").select("value")).where("label <> ''")
    one = labels.withColumn("key", key_of("country", slug_of(F.col("label")))).groupBy("key").agg(F.min("label").alias("label"))
    return one.select("key", F.lit("country").alias("kind"), "label", F.lit("country").alias("description"), key_of("class", F.lit("country")).alias("cls"), F.lit("places").alias("tbl"), F.lit(None).cast("string").alias("row"))


def _terms(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = key_of(F.col("kind"), F.col("id"))
    items = vocab.select(key.alias("key"), "kind", "label", F.coalesce("description", F.lit("")).alias("description"), key_of("class", F.col("kind")).alias("cls"), F.lit("code").alias("tbl"), F.lit(None).cast("string").alias("row")).dropDuplicates(["key"])
    parents = vocab.where("parent IS NOT NULL") if "parent" in vocab.columns else vocab.limit(0).withColumn("parent", F.lit(""))
    claims = parents.select(key.alias("key"), F.lit(-1).alias("rank"), F.lit("").alias("row"), F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit("subclass of").alias("prop"), F.lit("item").alias("kind"), key_of(F.col("kind"), F.col("parent")).alias("value"), F.lit(None).cast("string").alias("extra"), F.array().cast(f"array<{QUAL}>").alias("quals"), F.lit(False).alias("repeat"))
    return items, claims


def stage_report(drafts: DataFrame, tables: dict[str, DataFrame], lineage: DataFrame | None = None) -> DataFrame:
    """tbl, rows, items, used, ignored: what became of each table's rows and of its public columns.

    items counts what the table's rows made: every item of their own, and persons that nobody had before.
    """
    spark = drafts.sparkSession
    one = drafts.where("tbl <> 'season_entries'").groupBy("tbl").agg(F.countDistinct("row").alias("rows"), F.countDistinct(F.when(F.col("made") & F.col("counted"), F.col("key"))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("used")))).alias("used"))
    public = [(t, public_of(df)) for t, df in tables.items()]
    every = spark.createDataFrame(public, "tbl string, public array<string>")
    return one.join(F.broadcast(every), "tbl").select("tbl", "rows", "items", "used", F.array_sort(F.array_except("public", "used")).alias("ignored"))
