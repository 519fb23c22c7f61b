"""Capture sessions in zip archives, and corpora of JSON lines: tolerant readers that say what they left out."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import device_line

#: Limits of an upload in bytes and files, and what its files may be called.
MOST_ZIP, MOST_FILE, MOST_FILES, MOST_MANIFEST = 80 << 20, 12 << 20, 400, 12 << 20
NAME = re.compile(r"^(images/)?[A-Za-z0-9][A-Za-z0-9._-]{0,80}$")
IMAGES = (".jpg", ".jpeg", ".png", ".webp")
DECISIONS = ("new_piece", "re_registered", "match_confirmed", "match_rejected", "undecided")

FILES = "path string, role string, name string, size long, sha256 string, data binary, manifest string, error string"


class Refused(Exception):
    """An upload that isn't taken; its text is the code."""


def safe_name(name: str) -> str | None:
    """Where a picture of an archive goes: images/ and its name; None for anything that climbs out or is no picture."""
    n = name.replace("\\", "/").strip()
    n = n.removeprefix("images/") if n.startswith("images/images/") else n
    if n.startswith((".", "/")) or ".." in n or not NAME.match(n) or not n.lower().endswith(IMAGES):
        return None
    return n if n.startswith("images/") else f"images/{n}"


def is_image(data: bytes) -> bool:
    return data[:3] == b"\xff\xd8\xff" or data[:8] == b"\x89PNG\r\n\x1a\n" or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")


def _manifest(raw: bytes, broken: str) -> str:
    try:
        got = json.loads(raw.decode("utf-8"))
    except ValueError as e:
        raise Refused(broken) from e
    if not isinstance(got, dict):
        raise Refused("not_an_object")
    return json.dumps(got, ensure_ascii=False)


def unpack(content: bytes) -> tuple[str, Iterator[tuple[str, bytes]]]:
    """The manifest of an upload, and its pictures one by one; raises Refused before any of them is handed out."""
    if not content:
        raise Refused("empty")
    if content[:2] != b"PK":
        return _manifest(content, "neither_zip_nor_json"), iter(())
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in archive.infolist() if not i.is_dir()]
        if len(archive.infolist()) > MOST_FILES:
            raise Refused("too_many_files")
        manifest, pictures = None, {}
        for info in infos:
            base = info.filename.replace("\\", "/")
            if base.lower().endswith("manifest.json"):
                if manifest is None:
                    if info.file_size > MOST_MANIFEST:
                        raise Refused("manifest_too_large")
                    manifest = archive.read(info)
                    _manifest(manifest, "bad_manifest") if not _parses_to_other(manifest) else None
                continue
            name = safe_name(base) or safe_name(base.split("/")[-1])
            if name is None:
                continue
            if info.file_size > MOST_FILE:
                raise Refused("file_too_large")
            if is_image(archive.read(info)):  # read here, so that a broken file refuses the whole; kept by none
                pictures[name] = info
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError) as e:
        raise Refused("bad_zip") from e
    if manifest is None:
        raise Refused("no_manifest")
    return _manifest(manifest, "bad_manifest"), ((n, archive.read(i)) for n, i in pictures.items())


def _parses_to_other(raw: bytes) -> bool:
    """JSON that is no object is only refused after all files were looked at."""
    try:
        return not isinstance(json.loads(raw.decode("utf-8")), dict)
    except ValueError:
        return False


def load_session_zips(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """FILES: for every upload below path one row of role `session` with its manifest as JSON or an error code, and a row of role `image`
    for each picture of those that are taken.

    Codes: empty (a table's alone: Spark doesn't list empty files), too_large, too_many_files, manifest_too_large, file_too_large, bad_zip, bad_manifest, no_manifest, not_an_object,
    neither_zip_nor_json. Spark reads the files wherever they are; what is over MOST_ZIP isn't read at all. Pictures are handed on one by one,
    so a task holds an upload and one of its files. Of files that end up under one name the last stands; files that are no
    pictures are left out, and a nested archive is none.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    none = (F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("size", "long"), ("sha256", "string"), ("data", "binary"), ("manifest", "string")))
    large = found.where(F.col("length") > MOST_ZIP).select("path", F.lit("session").alias("role"), *none, F.lit("too_large").alias("error"))
    return unpack_uploads(found.where(F.col("length") <= MOST_ZIP).select("path", "content")).unionByName(large)


def unpack_uploads(uploads: DataFrame) -> DataFrame:
    """FILES of uploads (path, content) that a table holds; a null content is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("role", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("data", pa.binary()), ("manifest", pa.string()), ("error", pa.string())])
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column("path")[i].as_py()
                try:
                    manifest, pictures = unpack(batch.column("content")[i].as_py())
                except Refused as e:
                    yield row(path, "session", None, None, None, None, None, str(e))
                    continue
                yield row(path, "session", None, None, None, None, manifest, None)
                for name, data in pictures:
                    yield row(path, "image", name, len(data), hashlib.sha256(data).hexdigest(), data, None, None)

    return uploads.select("path", "content").mapInArrow(run, FILES)


def _text(v: Column, path: str, most: int = 200) -> Column:
    return F.left(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")), F.lit(most))


def _whole(v: Column, path: str) -> Column:
    """A number rounded to the even neighbour, null for anything else."""
    return F.bround(F.try_variant_get(v, path, "double")).cast("long")


def session_index(df: DataFrame, id: str, manifest: str) -> DataFrame:
    """id and the columns that a list of sessions shows, from the JSON of a manifest: kind, app_version, device, object_id, object_row_id,
    object_title, decision, decision_note, verdict, confidence, rating, descriptor, n_frames, has_embeddings, top_candidate, top_score,
    n_candidates. Parts of another kind than expected count as missing; a text that is no JSON gives an empty session.
    """
    v = F.coalesce(F.try_parse_json(manifest), F.parse_json(F.lit("{}")))
    df = df.select(id, v.alias("v")).withColumns({"items": F.try_variant_get("v", "$.candidates.items", "array<variant>"), "frames": F.try_variant_get("v", "$.fingerprint.frames", "array<variant>"), "has_match": F.try_variant_get("v", "$.match", "map<string, variant>").isNotNull() & (F.size(F.try_variant_get("v", "$.match", "map<string, variant>")) > 0)})
    df = df.withColumns({"top": F.try_variant_get(F.get("items", 0), "$", "map<string, variant>"), "dec": F.coalesce(F.try_variant_get("v", "$.decision.object", "map<string, variant>"), F.try_variant_get("v", "$.object", "map<string, variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string, variant>"))})
    v, top = F.col("v"), F.get("items", 0)
    obj = lambda key: F.try_variant_get(F.try_element_at("dec", F.lit(key)), "$", "string")
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    kind = F.lower(_text(v, "$.kind", 20))
    checked = F.col("has_match") | (F.size(F.try_variant_get(v, "$.reference", "map<string, variant>")) > 0)
    decision = some(_text(v, "$.decision.decision", 30), F.lit("undecided"))
    ref_kind = _text(v, "$.reference.kind")
    embedded = F.coalesce(F.try_variant_get(v, "$.fingerprint.metadata.hasEmbeddings", "boolean"), F.lit(False)) | F.exists("frames", lambda f: F.size(F.coalesce(F.try_variant_get(f, "$.emb", "array<variant>"), F.array().cast("array<variant>"))) > 0) | (_text(v, "$.match.descriptor") == "dino")
    ua, w, h = _text(v, "$.device.ua", 2000), _whole(v, "$.device.resolution.w"), _whole(v, "$.device.resolution.h")
    device = F.concat_ws(" · ", F.nullif(device_line(ua, w, h), F.lit("")), F.when(~F.try_variant_get(v, "$.device.compass", "boolean"), "no compass"))
    fingerprint = F.size(F.try_variant_get(v, "$.fingerprint", "map<string, variant>")) > 0
    return df.select(
        id, F.when(kind.isin("enroll", "verify"), kind).when(F.coalesce(checked, F.lit(False)), "verify").otherwise("enroll").alias("kind"), F.left(some(_text(v, "$.app.version"), _text(v, "$.version")), F.lit(60)).alias("app_version"), F.left(device, F.lit(200)).alias("device"),
        F.when(obj("id").isNotNull() & obj("id").rlike("^[0-9]+$"), obj("id").try_cast("long")).when(ref_kind == "mine", _whole(v, "$.reference.id")).alias("object_id"),
        F.nullif(F.left(some(obj("row_id"), F.when(ref_kind == "public", _text(v, "$.reference.id"))), F.lit(80)), F.lit("")).alias("object_row_id"), F.left(some(obj("title"), _text(v, "$.reference.title")), F.lit(200)).alias("object_title"),
        F.when(decision.isin(*DECISIONS), decision).otherwise("undecided").alias("decision"), _text(v, "$.decision.note", 1000).alias("decision_note"), F.left(some(_text(v, "$.match.verdict"), _text(top, "$.label")), F.lit(40)).alias("verdict"),
        F.when(F.col("has_match"), _whole(v, "$.match.confidence")).otherwise(_whole(top, "$.confidence")).alias("confidence"), F.when(F.coalesce(fingerprint, F.lit(False)), _whole(v, "$.fingerprint.rating")).otherwise(_whole(v, "$.reference.rating")).alias("rating"),
        F.left(some(_text(v, "$.match.descriptor"), _text(v, "$.candidates.descriptor"), _text(v, "$.session.descriptor")), F.lit(20)).alias("descriptor"),
        F.coalesce(F.nullif(F.size("frames").cast("long"), F.lit(0)), F.nullif(_whole(v, "$.match.shots"), F.lit(0)), _whole(v, "$.session.shots"), F.lit(0)).alias("n_frames"), F.coalesce(embedded, F.lit(False)).alias("has_embeddings"),
        F.left(some(_text(top, "$.title"), _text(top, "$.ref")), F.lit(200)).alias("top_candidate"), _whole(top, "$.confidence").alias("top_score"), F.coalesce(F.size("items"), F.lit(0)).alias("n_candidates"),
    )


def read_corpus_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records: object_id, title, techniques, traits, dominant_colour, embedding_centroid; left_out: reason, n) of files of JSON lines.

    Of each object the first record with a vector counts, in the order of file names and of lines. Left out are blank lines, `broken` ones
    (no JSON), those that are `no_object`, have `no_id` or `no_vector` (none, empty, or with an entry that is no number), and `repeated` ones.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    v = F.try_parse_json(F.trim("value"))
    rows = lines.withColumn("v", v).withColumns({"object": F.try_variant_get("v", "$", "map<string, variant>"), "vector": F.try_variant_get("v", "$.embedding_centroid", "array<variant>"), "id_kind": F.schema_of_variant(F.try_variant_get("v", "$.object_id", "variant"))})
    oid = F.try_variant_get("v", "$.object_id", "string")
    rows = rows.withColumns({"id": F.when((F.col("id_kind") == "STRING") | ~oid.isin("0", "0.0", "false"), F.nullif(oid, F.lit(""))), "x": F.transform("vector", lambda e: F.try_variant_get(e, "$", "double"))})
    good = (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull())
    reason = F.when(F.trim("value") == "", "blank").when(F.col("v").isNull(), "broken").when(F.col("object").isNull(), "no_object").when(F.col("id").isNull(), "no_id").when(~F.coalesce(good, F.lit(False)), "no_vector")
    rows = rows.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("id").orderBy("f", "b", "i"))
    ranked = rows.where("reason IS NULL").withColumn("reason", F.when(first > 1, "repeated"))
    texts = lambda path: F.filter(F.transform(F.try_variant_get("v", path, "array<variant>"), lambda e: F.try_variant_get(e, "$", "string")), lambda t: t != "")
    lists = F.transform_values(F.try_variant_get("v", "$.traits", "map<string, variant>"), lambda _, x: F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: F.try_variant_get(e, "$", "string")))
    empty = F.array().cast("array<string>")
    records = ranked.where("reason IS NULL").select(
        F.col("id").alias("object_id"), F.coalesce(F.try_variant_get("v", "$.title", "string"), F.lit("")).alias("title"), F.coalesce(texts("$.techniques"), empty).alias("techniques"), F.map_filter(lists, lambda _, x: F.size(x) > 0).alias("traits"),
        F.to_json(F.try_variant_get("v", "$.dominant_colour", "variant")).alias("dominant_colour"), F.col("x").alias("embedding_centroid"),
    )
    left = rows.where("reason IS NOT NULL").select("reason").unionAll(ranked.where("reason IS NOT NULL").select("reason"))
    return records, left.groupBy("reason").agg(F.count("*").alias("n"))
