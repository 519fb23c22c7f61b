"""What a page of a record shows: readable facts, public fields, links, related rows; and who a name is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import norm
from tessera.operators.staging import blank, public_of
from tessera.operators.tables import GEO, column_class

#: Facts that aren't shown, and how many of an item are.
HIDDEN, MOST_FACTS = ("content hash", "image URL", "described at URL"), 60
FIELD = "struct<column: string, label: string, value: string>"


def facts(claims: DataFrame, items: DataFrame, hidden: tuple[str, ...] = HIDDEN, most: int = MOST_FACTS) -> DataFrame:
    """key, n (from 1), prop, kind, value, item, url, qualifiers (an array of "prop: value") of the first `most` claims of each key.

    Items, units and items in qualifiers are shown by their label, by their key where none is known; a time without its sign and hours.
    Claims without a value don't count. claims: key, n, prop, kind, value, extra, quals. items: key, label.
    """
    label = lambda to: items.select(F.col("key").alias(to), F.col("label").alias(f"{to}_label"))
    own = claims.where(~F.col("prop").isin(*hidden) & (F.coalesce("value", F.lit("")) != ""))
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "prop", "value"))
    own = own.withColumn("n", place).where(F.col("n") <= most)
    quals = own.select("key", "n", F.posexplode("quals").alias("q", "x")).where("coalesce(x.value, '') <> ''").withColumn("qi", F.when(F.col("x.kind") == "item", F.col("x.value")))
    quals = quals.join(label("qi"), "qi", "left").groupBy("key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", F.concat("x.prop", F.lit(": "), F.coalesce("qi_label", "x.value")).alias("t")))), lambda x: x["t"]).alias("qualifiers"))
    own = own.withColumns({"item": F.when(F.col("kind") == "item", F.col("value")), "unit": F.when(F.col("kind") == "quantity", F.col("extra"))})
    own = own.join(label("item"), "item", "left").join(label("unit"), "unit", "left").join(quals, ["key", "n"], "left")
    value = (
        F.when(F.col("kind") == "item", F.coalesce("item_label", "value")).when(F.col("kind") == "quantity", F.trim(F.concat_ws(" ", "value", F.coalesce("unit_label", "unit"))))
        .when(F.col("kind") == "time", F.split(F.regexp_replace("value", r"^\++", ""), "T")[0]).otherwise(F.col("value"))
    )
    return own.select("key", "n", "prop", "kind", value.alias("value"), "item", F.when(F.col("kind") == "url", F.col("value")).alias("url"), F.coalesce("qualifiers", F.array().cast("array<string>")).alias("qualifiers"))


def shown_columns(df: DataFrame) -> list[str]:
    """Public columns that aren't ids, coordinates, dates of birth or demographics."""
    return [c for c in public_of(df) if c not in GEO and c != "id" and not c.endswith("_id") and column_class(c) not in ("birth", "demographic")]


def row_fields(df: DataFrame, tbl: str, id: str = "_row_id") -> DataFrame:
    """tbl, row, fields (an array of column, label, value) of the filled public columns of each row."""
    each = [F.when(blank(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("column"), F.lit(c.replace("_", " ").strip().capitalize()).alias("label"), F.trim(F.col(c).cast("string")).alias("value"))) for c in shown_columns(df) if not df.schema[c].dataType.typeName() in ("array", "map", "struct", "binary")]
    return df.select(F.lit(tbl).alias("tbl"), F.col(id).cast("string").alias("row"), F.array_compact(F.array(*each).cast(f"array<{FIELD}>")).alias("fields"))


def _value(fields: Column, *names: str) -> Column:
    """The value of the first of the names that is a field."""
    one = lambda name: F.get(F.filter(fields, lambda f: f["column"] == name), 0)["value"]
    return F.coalesce(*map(one, names))


def described(kind: Column, fields: Column) -> Column:
    """A line about a row that has no item yet, from its fields."""
    first = lambda *names: _value(fields, *names)
    tech = F.lower(F.trim(F.split(F.split(first("primary_technique", "technique", "techniques"), ",")[0], "/")[0]))
    person = F.concat_ws(", ", F.when(tech.isNull() | (tech == ""), "glass artist").when(F.contains(tech, F.lit("glass")), tech).otherwise(F.concat(tech, F.lit(" glass artist"))), first("based_in", "location", "city", "studio"))
    where = F.nullif(F.concat_ws(", ", first("city"), first("region", "country")), F.lit(""))
    studio = F.concat_ws(" in ", F.coalesce(F.lower(first("type")), F.lit("glass studio")), where)
    piece = F.concat_ws(", ", F.concat_ws(" by ", F.lit("glass piece"), first("maker")), first("year"))
    return F.when(kind == "person", person).when(kind == "studio", studio).when(kind == "object", piece).otherwise(kind)


def _encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def record_links(key: Column, kind: Column, label: Column, row: Column, fields: Column, said: Column) -> Column:
    """A map of links: to the record's own pages by kind, website and Instagram from its fields, else from its facts."""
    web = F.get(F.filter(fields, lambda f: F.contains(f["column"], F.lit("website")) | f["column"].isin("url", "web", "link")), 0)["value"]
    insta = F.ltrim(F.get(F.filter(fields, lambda f: F.contains(f["column"], F.lit("instagram"))), 0)["value"], F.lit("@"))
    told = lambda prop: F.get(F.filter(said, lambda x: x["prop"] == prop), 0)["value"]
    page = lambda name: F.concat(F.lit("https://www.instagram.com/"), name, F.lit("/"))
    links = {
        "maker": F.when(kind == "person", F.concat(F.lit("/maker.html?m="), _encoded(key))), "map": F.when(kind == "studio", F.concat(F.lit("/studios.html?q="), _encoded(label))), "directory": F.when(kind.isin("person", "studio"), F.concat(F.lit("/explore/?view=datasets&q="), _encoded(label))),
        "piece": F.when((kind == "object") & row.isNotNull(), F.concat(F.lit("/explore/?view=objects&piece="), _encoded(row))), "image": F.when((kind == "object") & row.isNotNull(), F.concat(F.lit("/api/objects/"), row, F.lit("/image"))), "events": F.when(kind.isin("show", "event"), "/events.html"),
        "website": F.coalesce(web, told("official website")), "instagram": F.coalesce(F.when(insta.startswith("http"), insta).otherwise(page(insta)), page(F.ltrim(told("Instagram username"), F.lit("@")))),
    }
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in links.items()]))
    return F.map_from_entries(entries)


def record_documents(items: DataFrame, claims: DataFrame, tables: dict[str, DataFrame], keys: DataFrame | None = None, held: DataFrame | None = None, most: int = 50) -> DataFrame:
    """key, kind, label, description, fields, facts, links, pieces, n_pieces, makers, n_makers, collected for the asked keys, or for all.

    items and claims: as staged. tables: the gated source tables by name; objects has title, maker, year, and studios are those where
    season_entries or pieces were made. A person's pieces are those under its name, the newest `most` of them with their number in all; a
    studio's makers are those of its entries; collected counts the held claims (object_row_id, status) of a piece. Keys that nobody has
    give no row.
    """
    own = items.select("key", "kind", "label", "description", "tbl", "row")
    own = own.join(keys.select("key").distinct(), "key", "left_semi") if keys is not None else own
    fields = reduce(DataFrame.unionByName, [row_fields(df, t) for t, df in tables.items() if "_row_id" in df.columns])
    read = facts(claims.join(own.select("key"), "key", "left_semi"), items)
    told = read.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "prop", "value", "item", "url", "qualifiers"))).alias("facts"))
    out = own.join(fields, ["tbl", "row"], "left").join(told, "key", "left")
    out = out.withColumns({"fields": F.coalesce("fields", F.array().cast(f"array<{FIELD}>")), "facts": F.coalesce("facts", F.array().cast(dict(told.dtypes)["facts"])), "name": norm(F.col("label"))})

    def best(df: DataFrame, name: str, order: list, what: Column, to: str) -> DataFrame:
        """The first `most` rows of each name, and how many there are."""
        by = Window.partitionBy("name")
        ranked = df.withColumn("name", norm(F.col(name))).where("name <> ''").withColumns({"k": F.row_number().over(by.orderBy(*order)), f"n_{to}": F.count("*").over(by)}).where(F.col("k") <= most)
        return ranked.groupBy("name", f"n_{to}").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", what.alias("x")))), lambda r: r["x"]).alias(to))

    pieces = best(tables["objects"], "maker", [F.desc_nulls_last("year"), "_row_id"], F.struct("_row_id", "title", "year"), "pieces") if "objects" in tables else None
    makers = best(tables["season_entries"].where("status = 'approved'").groupBy(norm(F.col("studio")).alias("studio"), norm(F.col("artist_name")).alias("m")).agg(F.count("*").alias("entries"), F.min("artist_name").alias("maker")), "studio", [F.desc("entries"), "maker"], F.struct("maker", "entries"), "makers") if "season_entries" in tables and "artist_name" in tables["season_entries"].columns else None
    for kind, more, to in (("person", pieces, "pieces"), ("studio", makers, "makers")):
        if more is None:
            out = out.withColumns({to: F.lit(None), f"n_{to}": F.lit(0).cast("long")})
            continue
        out = out.withColumn("_n", F.when(F.col("kind") == kind, F.col("name"))).join(more.withColumnRenamed("name", "_n"), "_n", "left").drop("_n").withColumn(f"n_{to}", F.coalesce(f"n_{to}", F.lit(0).cast("long")))
    if held is not None:
        n = held.where(F.col("status").isin("verified", "approved")).groupBy(F.col("object_row_id").cast("string").alias("_o")).agg(F.count("*").alias("collected"))
        out = out.withColumn("_o", F.when(F.col("kind") == "object", F.col("row"))).join(n, "_o", "left").drop("_o").withColumn("collected", F.when(F.col("kind") == "object", F.coalesce("collected", F.lit(0).cast("long"))))
    else:
        out = out.withColumn("collected", F.lit(None).cast("long"))
    description = F.coalesce(F.nullif("description", F.lit("")), described(F.col("kind"), F.col("fields")))
    links = record_links(F.col("key"), F.col("kind"), F.col("label"), F.col("row"), F.col("fields"), F.col("facts"))
    return out.select("key", "kind", "label", description.alias("description"), "fields", "facts", links.alias("links"), "pieces", "n_pieces", "makers", "n_makers", "collected")


def maker_identities(asked: DataFrame, directory: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """id, name, key, row_key, item_key, seen for everyone asked for whom anything is known.

    asked: id, names (an array, the surest first), account (whether an account stands behind it, which is enough). directory: key, name.
    items: key, kind, label. seen: name, of published pieces and approved entries. The first name with a directory row gives the row, the
    first with a person's item the item (the directory's items first, then the smallest key); without one, the row's own item is
    taken. The name shown is the item's, the row's, or the first that was given.
    """
    names = asked.select("id", F.posexplode("names").alias("n", "name")).withColumn("k", norm(F.col("name"))).where("k <> ''")
    rows = directory.select(F.col("key").alias("row_key"), F.col("name").alias("row_name"), norm(F.col("name")).alias("k"))
    row = names.join(rows, "k").groupBy("id").agg(F.min(F.struct("n", "row_key", "row_name")).alias("r"))
    people = items.where("kind = 'person'").select(F.col("key").alias("item_key"), F.col("label").alias("item_label"), F.lower(F.trim("label")).alias("k"))
    item = names.join(people, "k").groupBy("id").agg(F.min(F.struct("n", (~F.col("item_key").startswith("reg:artists:")).alias("o"), "item_key", "item_label")).alias("w"))
    known = names.join(seen.select(norm(F.col("name")).alias("k")).distinct(), "k", "left_semi").select("id").distinct().withColumn("seen", F.lit(True))
    first = names.groupBy("id").agg(F.min(F.struct("n", "name"))["name"].alias("first"))
    out = asked.select("id", F.coalesce("account", F.lit(False)).alias("account")).join(row, "id", "left").join(item, "id", "left").join(known, "id", "left").join(first, "id", "left")
    own = items.select(F.col("key").alias("own_key"), F.col("label").alias("own_label"))
    out = out.withColumn("own_key", F.when(F.col("w").isNull(), F.col("r.row_key"))).join(own, "own_key", "left").withColumn("item_key", F.coalesce("w.item_key", F.when(F.col("own_label").isNotNull(), F.col("own_key"))))
    out = out.withColumn("seen", F.coalesce("seen", F.lit(False))).where("account OR r IS NOT NULL OR item_key IS NOT NULL OR seen")
    return out.select("id", F.coalesce("w.item_label", "own_label", "r.row_name", "first", F.lit("A maker")).alias("name"), F.coalesce("item_key", "r.row_key").alias("key"), F.col("r.row_key").alias("row_key"), "item_key", "seen")


def reprocess(sessions: DataFrame, columns: list[str], measure: Callable[[pa.RecordBatch], list[dict[str, float | None]]], inputs: list[str], truth: bool = True) -> DataFrame:
    """sessions with now_<c> for each of columns, as `measure` finds them anew from batches of `inputs`, and change_<c>, what that differs
    from the old value; with truth (columns true_<c>) also error_<c> and was_<c>, how far the new and the old value are from it.

    measure takes an Arrow batch and gives a row of values each; a value that it leaves out is null. Columns beside are kept.
    """
    kept = sessions.columns
    kinds = dict(sessions.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.select(inputs))
            if len(found) != batch.num_rows:
                raise ValueError("measure must give one row for each of the batch")
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(c) for r in found], pa.float64()) for c in columns)], [*kept, *(f"now_{c}" for c in columns)])

    out = sessions.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`now_{c}` double" for c in columns)]))
    more = {f"change_{c}": F.col(f"now_{c}") - F.col(c) for c in columns}
    if truth:
        more |= {f"error_{c}": F.col(f"now_{c}") - F.col(f"true_{c}") for c in columns} | {f"was_{c}": F.col(c) - F.col(f"true_{c}") for c in columns}
    return out.withColumns(more)


def reprocess_report(done: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, measure, n, gained, lost, changed, mean_error, mean_abs_error, rmse, was_abs_error, better: statistics of `reprocess` with truth."""
    each = done.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("old"), F.col(f"now_{c}").alias("new"), F.col(f"error_{c}").alias("e"), F.col(f"was_{c}").cast("double").alias("w")) for c in columns])).alias("m")).select(*by, "m.*")
    return each.groupBy(*by, "measure").agg(
        F.count("*").alias("n"), F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("gained"), F.count_if(F.col("old").isNotNull() & F.col("new").isNull()).alias("lost"), F.count_if(F.col("old") != F.col("new")).alias("changed"),
        F.avg("e").alias("mean_error"), F.avg(F.abs("e")).alias("mean_abs_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("w")).alias("was_abs_error"), F.count_if(F.abs("e") < F.abs("w")).alias("better"),
    )


def review_table(items: DataFrame, claims: DataFrame, hidden: tuple[str, ...] = ("registry key",), props: list[str] | None = None) -> DataFrame:
    """A row for each item: key, label, description, and a column for each property with its values, joined by " | " in order; item values
    as key [label].

    props: the properties, in order; without them, those that the items use, most used first and then by name (a job of its own, as a
    table's columns must be known). Items without a value have an empty text there.
    """
    own = claims.join(items.select("key"), "key", "left_semi").where(~F.col("prop").isin(*hidden))
    if props is None:
        props = [r["prop"] for r in own.groupBy("prop").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prop").collect()]
    label = items.select(F.col("key").alias("value"), F.col("label").alias("_label"))
    told = own.join(label, "value", "left").withColumn("t", F.when((F.col("kind") == "item") & (F.col("_label") != ""), F.concat("value", F.lit(" ["), "_label", F.lit("]"))).otherwise(F.col("value")))
    wide = told.groupBy("key").pivot("prop", props).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " | "))
    return items.select("key", "label", "description").join(wide, "key", "left").fillna("", props)


def filter_pieces(pieces: DataFrame, q: str = "", maker: str = "", piece: str = "", searched: tuple[str, ...] = ("title", "maker", "techniques", "year", "description")) -> DataFrame:
    """The pieces of an id, of a maker (any case and spaces), and with q inside one of the searched columns; what is blank isn't asked for."""
    low = lambda t: " ".join(t.split()).lower()
    if piece.strip():
        pieces = pieces.where(F.col("_row_id").cast("string") == piece.strip())
    if low(maker):
        pieces = pieces.where(norm(F.col("maker")) == low(maker))
    if low(q):
        pieces = pieces.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(norm(F.col(c).cast("string")), F.lit(low(q))), F.lit(False)) for c in searched if c in pieces.columns]))
    return pieces


def board_listing(df: DataFrame, tbl: str, approvals: DataFrame, order: str = "_imported_at") -> DataFrame:
    """The approved rows of a form's table with their id and public columns, newest first."""
    yes = approvals.where((F.col("tbl") == tbl) & (F.col("status") == "approved")).select(F.col("row_id").alias("_row_id"))
    return df.join(yes, "_row_id", "left_semi").orderBy(F.desc_nulls_last(order), "_row_id").select("_row_id", *public_of(df))


def read_studio_summaries(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """source (the file's name), ok, and a column for each of aliases: the first of its keys that is a number in a landed JSON summary, else 0.

    A file is one document; ok tells whether it is an object. Texts that look like numbers don't count, as with the sources' own contract.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("source"), F.try_parse_json("value").alias("v"))
    number = lambda k: F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")), "^[A-Z]+", 0).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get("v", f"$.{k}", "double"))
    ok = F.coalesce(F.try_variant_get("v", "$", "map<string, variant>").isNotNull(), F.lit(False))
    return files.select("source", ok.alias("ok"), *[F.coalesce(*map(number, keys), F.lit(0.0)).alias(name) for name, keys in aliases.items()])
