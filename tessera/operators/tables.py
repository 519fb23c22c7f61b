"""Schemas, catalogs, imports and exports, privacy and filters over registry tables."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import valid_point
from tessera.shared import cut

#: Housekeeping columns; parts of names whose columns aren't public.
HOUSEKEEPING = ("_row_id", "_source_file", "_source_sheet", "_imported_at")
PRIVATE = ("email", "e_mail", "phone", "contact", "claim_token", "internal_notes", "street_address", "^address$", "^source$")
#: Names of columns with people's names, dates of birth, and what is never shown for a row.
NAMES = {"artist_name", "artist", "display_name", "full_name", "first_name", "last_name", "led_by", "student_name", "mentor_name", "contact_name", "person", "founder"}
NAME_WORDS = ("artist", "person", "maker", "student", "mentor", "contact", "instructor", "teacher")
BIRTH = r"(^|_)(birth|dob|born|death|died)(_|$)|birth_year|death_year|date_of_birth|year_of_birth"
PLACE = r"reside|where_|base|nationality|location|country|city|town|from_"
DEMOGRAPHIC = r"ethnic|gender|pronoun|\brace\b|religio|disab|sexual|orientation|income|salary|marital|citizen|immigra|veteran|\bage\b|how old|years old"
GEO = ("lat", "lng", "latitude", "longitude")


def slug_columns(names: list[str], most: int = 48) -> list[str]:
    """A slug for each header: lower case, runs of other signs one `_`, `c_` before a digit, repeats numbered from 2."""
    used: set[str] = set()
    out = []
    for name in names:
        s = re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_") or "col"
        s = (f"c_{s}" if s[0].isdigit() else s)[:most]
        n = 2
        unique = s
        while unique in used:
            unique, n = f"{s}_{n}", n + 1
        used.add(unique)
        out.append(unique)
    return out


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet as a table: slugged columns, trimmed texts, no fully blank rows, coordinates as numbers."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = raw.toDF(*slug_columns(raw.columns))
    df = df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns])
    df = df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in df.columns]))
    return df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in GEO else F.col(c) for c in df.columns])


def build_registry(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]], labels: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(datasets: tbl, domain, visibility, n_rows; columns: tbl, column, label, ordinal, is_public) of tables (df, domain, visibility)."""
    sets = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("tbl"), F.lit(d).alias("domain"), F.lit(v).alias("visibility"), "n_rows") for t, (df, d, v) in tables.items()])
    rows = [(t, c, (labels or {}).get(c, c.replace("_", " ").strip().capitalize()), i, not is_private(c)) for t, (df, _, _) in tables.items() for i, c in enumerate(x for x in df.columns if x not in HOUSEKEEPING)]
    return sets, spark.createDataFrame(rows, "tbl string, column string, label string, ordinal int, is_public boolean")


def is_private(column: str) -> bool:
    return any(re.search(p, column.lower()) for p in PRIVATE)


def column_class(column: str, label: str = "") -> str:
    """person, birth, demographic or plain: what a column's name says about its rows."""
    c = column.lower()
    if c in NAMES or (c.endswith("_name") and c.startswith(NAME_WORDS)):
        return "person"
    if re.search(BIRTH, c) and not re.search(PLACE, c):
        return "birth"
    return "demographic" if re.search(DEMOGRAPHIC, c.replace("_", " ")) or re.search(DEMOGRAPHIC, label.lower()) else "plain"


def public_columns(df: DataFrame, admin: bool = False) -> DataFrame:
    """df without its private columns; housekeeping columns stay."""
    return df if admin else df.select(*[c for c in df.columns if c in HOUSEKEEPING or not is_private(c)])


def privacy_project(df: DataFrame, rows: bool = True) -> DataFrame:
    """df without names of people, dates of birth and demographics where rows are shown; aggregates keep the last two."""
    hidden = {"person", "birth", "demographic"} if rows else {"person"}
    return df.select(*[c for c in df.columns if column_class(c) not in hidden])


def visible_datasets(datasets: DataFrame, approvals: DataFrame, admin: bool = False) -> DataFrame:
    """datasets with approved rows (n_approved); restricted ones are for admins, those without any approved row for nobody else."""
    n = approvals.where("status = 'approved'").groupBy("tbl").agg(F.count("*").alias("n_approved"))
    both = datasets.join(n, "tbl", "left").fillna(0, ["n_approved"])
    return both if admin else both.where("visibility = 'public' AND n_approved > 0")


def append_submissions(base: DataFrame, batch: DataFrame, many: tuple[str, ...] = ()) -> DataFrame:
    """batch as pending rows in base's columns; several answers are joined by ` | `. Unknown columns are an error."""
    unknown = [c for c in batch.columns if c not in base.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    put = batch.select(*[F.array_join(c, " | ").alias(c) if c in many else F.col(c) for c in batch.columns])
    return base.unionByName(put.withColumn("status", F.lit("pending")) if "status" in base.columns else put, allowMissingColumns=True)


def import_csv(base: DataFrame, sheet: DataFrame, key: str = "_row_id", order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base with the sheet's rows upserted, report: updated, added, skipped, approvals: row_id, status of every touched row).

    Rows go in the order of `order`, a column of the sheet, else as it is read. A known id is updated, and blank cells overwrite; a new
    one is added, unless all its cells are blank: such rows are skipped. The second row of a new id updates the first, so of rows that
    repeat an id the last stands. Rows without an id are added each under an id of their own, equal ones too. Columns that base
    doesn't have, and those that begin with an underscore, are ignored. Cells that aren't of a column's type are null there, and null
    text cells are empty.
    """
    known = [c for c in sheet.columns if c in base.columns and c != key and not c.startswith("_")]
    if not known:
        raise ValueError(f"none of the columns {', '.join(sheet.columns[:8])} is one of the table's")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in known}
    at = F.col(order) if order else F.monotonically_increasing_id()
    own = F.nullif(F.trim(F.col(key).cast("string")), F.lit("")) if key in sheet.columns else F.lit(None).cast("string")
    rows = sheet.select(own.alias("_id"), at.alias("_at"), F.struct(*[text[c].alias(c) for c in known]).alias("_v"), reduce(lambda a, b: a | b, [F.trim(text[c]) != "" for c in known]).alias("_filled"))
    rows = cut(rows.withColumn("_id", F.coalesce("_id", F.left(F.sha1(F.concat_ws("|", F.lit("csv"), F.col("_at").cast("string"), F.to_json("_v"))), F.lit(16)))))
    old = base.select(F.col(key).cast("string").alias("_id"), F.lit(True).alias("_old")).distinct()
    per = rows.groupBy("_id").agg(F.max_by("_v", "_at").alias("_v"), F.count("*").alias("_n"), F.min(F.when(F.col("_filled"), F.col("_at"))).alias("_first")).join(old, "_id", "left")
    per = cut(per.withColumn("_old", F.coalesce("_old", F.lit(False))))
    # Rows of a new id before its first filled one are skipped.
    early = rows.join(per.where("NOT _old").select("_id", F.col("_first").alias("_f")), "_id").groupBy("_id").agg(F.count_if(F.col("_f").isNull() | (F.col("_at") < F.col("_f"))).alias("_early"))
    counts = per.join(early, "_id", "left").fillna(0, ["_early"])
    add = ~F.col("_old") & F.col("_first").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    report = counts.agg(total(F.when(F.col("_old"), F.col("_n")).when(add, F.col("_n") - F.col("_early") - 1).otherwise(0)).alias("updated"), F.count_if(add).alias("added"), total(F.col("_early")).alias("skipped"))
    touched = per.where("_old OR _first IS NOT NULL")
    put = {c: F.col(f"_v.{c}") if base.schema[c].dataType.simpleString() == "string" else F.col(f"_v.{c}").try_cast(base.schema[c].dataType) for c in known}
    both = base.withColumn("_id", F.col(key).cast("string")).join(touched.select("_id", "_v"), "_id", "full")
    hit = F.col("_v").isNotNull()
    out = both.select(*[F.coalesce(F.col(key), F.col("_id").cast(base.schema[key].dataType)).alias(key) if c == key else F.when(hit, put[c]).otherwise(F.col(c)).alias(c) if c in known else F.col(c) for c in base.columns])
    return out, report, touched.select(F.col("_id").alias("row_id"), F.lit("approved").alias("status"))


def export_csv(df: DataFrame, path: str, key: str = "_row_id") -> None:
    """Every column, the id first, nulls empty."""
    df.select(key, *[c for c in df.columns if c != key]).write.csv(path, header=True, nullValue="", emptyValue="", escape='"', mode="error")


def snapshot(df: DataFrame, folder: str, stamp: str) -> None:
    """Write df below folder under its stamp."""
    df.write.mode("error").parquet(f"{folder}/stamp={stamp}")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """stamp, n_rows of the snapshots, the newest first."""
    return spark.read.option("inferSchema", False).parquet(folder).groupBy(F.col("stamp").cast("string").alias("stamp")).agg(F.count("*").alias("n_rows")).orderBy(F.desc("stamp"))


def prune(spark: SparkSession, folder: str, keep: int = 8) -> list[str]:
    """Deletes all but the newest `keep` snapshots below a folder; the stamps that went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(((s.getPath().getName().removeprefix("stamp="), s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("stamp=")), key=lambda x: x[0], reverse=True)
    for _, old in found[keep:]:
        fs.delete(old, True)
    return sorted(stamp for stamp, _ in found[keep:])


def restore(spark: SparkSession, folder: str, stamp: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/stamp={stamp}")


def get_rows(df: DataFrame, ids: DataFrame, key: str = "_row_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def facet_filter(df: DataFrame, picks: dict[str, str], grids: dict[str, list[str]], q: str = "") -> DataFrame:
    """Rows equal to every pick, with anything ticked in each grid (its columns), and q in a text or in a ticked column's name."""
    ticked = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    for c, v in picks.items():
        df = df.where(F.col(c) == v)
    for columns in grids.values():
        df = df.where(reduce(lambda a, b: a | b, [ticked(c) for c in columns]))
    if not q:
        return df
    in_grid = [c for cs in grids.values() for c in cs]
    texts = [F.coalesce(F.col(c), F.lit("")) for c, t in df.dtypes if t == "string" and c not in in_grid]
    marks = [F.when(ticked(c), c.replace("_", " ")).otherwise("") for c in in_grid]
    return df.where(F.contains(F.lower(F.concat_ws(" ", *texts, *marks)), F.lit(q.lower())))


def filter_sessions(df: DataFrame, q: str | None = None, since: str | None = None, **equal) -> DataFrame:
    """Sessions by kind, decision, uid or object, from a day on, with q in their id or device; what is None doesn't filter."""
    for c, v in equal.items():
        df = df if v is None else df.where(F.col(c) == v)
    df = df if since is None else df.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return df if not q else df.where(F.contains(F.lower(F.concat_ws(" ", "session", "device")), F.lit(q.lower())))


def redact_entries(entries: DataFrame, uid: str | None = None) -> DataFrame:
    """Entries as the public sees them: no account ids, `mine`; the legendary flag only for its maker or once it was claimed."""
    mine = F.coalesce(F.col("artist_uid") == F.lit(uid), F.lit(False))
    shown = mine | (F.col("rarity") == "legendary")
    return entries.withColumn("mine", mine).withColumn("legendary", F.when(shown, F.col("legendary"))).drop("artist_uid")


def consented(df: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose approved owner said yes (owners: the key, status, consent)."""
    return df.join(owners.where("status = 'approved' AND lower(trim(consent)) = 'yes'").select(key).distinct(), key, "left_semi")


def with_lookup(df: DataFrame, lookup: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """df with columns of a lookup table, null where it has no row."""
    return df.join(lookup.select(on, *columns), on, "left")


def distinct_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def minus(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_anti")


def label_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with both, only_a, only_b of two arrays of labels."""
    return df.withColumns({"both": F.array_intersect(a, b), "only_a": F.array_except(a, b), "only_b": F.array_except(b, a)})


def interleave(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """df with part: the rows of each group dealt in order to k parts in turn."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("part", F.pmod(n - 1, F.lit(k)).cast("int"))


def geojson(df: DataFrame, lat: str, lng: str, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON feature of each row with a valid point."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lng).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    return df.where(valid_point(F.col(lat), F.col(lng))).select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def _escaped(c):
    """A text value of a calendar: backslashes, semicolons, commas and line ends are escaped."""
    for sign, by in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(sign), F.lit(by))
    return c


@F.arrow_udf(StringType())
def _line(texts: pa.Array) -> pa.Array:
    """Lines of over 73 bytes go on in the next, after a space: each takes as many of the next 72 characters as fit into 73 bytes."""

    def one(text: str) -> str:
        parts = []
        while len(text.encode()) > 73:
            k = len(text[:72].encode()[:73].decode(errors="ignore"))
            parts.append(text[:k])
            text = " " + text[k:]
        return "\r\n".join([*parts, text])

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def ics_events(df: DataFrame, domain: str = "registry.example", stamp: str | None = None) -> DataFrame:
    """id, entry: a calendar entry of each row with a start (id, title, starts, ends as days; description, url, location where df has them).

    All-day, so the end is the day after. Values are escaped, lines are folded and end in CR LF. stamp: when the entries were made,
    as yyyyMMddTHHmmssZ.
    """
    day = lambda c: F.date_format(c, "yyyyMMdd")
    value = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", _line(F.concat(F.lit(f"{c.upper()}:"), _escaped(F.col(c).cast("string")))))
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{stamp}") if stamp else F.lit(None).cast("string"), F.concat(F.lit("DTSTART;VALUE=DATE:"), day("starts")),
        F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(F.greatest(F.coalesce("ends", "starts"), F.col("starts")), 1))), _line(F.concat(F.lit("SUMMARY:"), _escaped(F.coalesce("title", F.lit(""))))), *(value(c) for c in ("description", "url", "location") if c in df.columns),
        F.lit("TRANSP:TRANSPARENT"), F.lit("END:VEVENT"),
    ]
    return df.where("starts IS NOT NULL").select("id", F.concat_ws("\r\n", *lines).alias("entry"))


def ics_calendar(events: DataFrame, name: str, product: str = "registry") -> DataFrame:
    """n, line: a calendar's frame around the entries of `ics_events`, in order of id; written in order of n they are one file."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{product}//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}"]
    spark = events.sparkSession
    frame = spark.createDataFrame([(0, None, "\r\n".join(head)), (2, None, "END:VCALENDAR")], "part int, id string, line string")
    every = frame.unionByName(events.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("id"), F.col("entry").alias("line")))
    ranged = every.repartitionByRange("part", "id").sortWithinPartitions("part", "id")
    return ranged.select(F.monotonically_increasing_id().alias("n"), "line")


def jsonld(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, document: a linked-data object for each node; edges are arrays of ids by type, in order."""
    own = edges.groupBy("src", "type").agg(F.array_sort(F.collect_set("dst")).alias("ids")).groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "ids")))).alias("links"))
    both = nodes.join(own, nodes.id == own.src, "left")
    return both.select("id", F.to_json(F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), F.col("label").alias("name"), "links")).alias("document"))


def map_summary(df: DataFrame, lat: str, lng: str, country: str, kind: str) -> DataFrame:
    """points, countries, kinds of the rows with a valid point."""
    return df.where(valid_point(F.col(lat), F.col(lng))).agg(F.count("*").alias("points"), F.countDistinct(F.nullif(F.trim(country), F.lit(""))).alias("countries"), F.countDistinct(kind).alias("kinds"))


def people_and_bytes(sessions: DataFrame) -> DataFrame:
    """people, bytes, last, with_mat of capture sessions (uid, bytes, created_at, has_mat)."""
    return sessions.agg(F.countDistinct("uid").alias("people"), F.sum("bytes").alias("bytes"), F.max("created_at").alias("last"), F.count_if("has_mat").alias("with_mat"))


def studio_totals(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The sums of numbers that sources name differently: each name of aliases is the first of its columns that is a number."""
    first = lambda cs: F.coalesce(*[F.expr(f"try_cast(`{c}` AS double)") for c in cs if c in df.columns], F.lit(0.0))
    return df.agg(*[F.sum(first(cs)).alias(n) for n, cs in aliases.items()])
