"""A deterministic sharded WARC writer, and its reader.

Pages are range-sorted by page_id; each task writes gzip records and rolls to a new file by compressed size. Headers and
digests are made anew from the payload. A file is written under a temporary name and renamed to the one that its place in
the order gives, so a task that runs again replaces its own files; the manifest table names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load, new_dir, table
from tessera.llm.words import slices

ROLL_BYTES = 16 << 20
#: Records carry this date, so that equal input gives equal files.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each gzip member of a file, read piece by piece; a wrong block digest is an error."""
    z, data, raw = zlib.decompressobj(31), [], b""
    while raw or (raw := stream.read(size)):
        data.append(z.decompress(raw))
        raw = z.unused_data
        if z.eof:
            head, _, rest = b"".join(data).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            yield fields, block
            z, data = zlib.decompressobj(31), []


def write_warc(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under root; the manifest: file, records, bytes.

    Of rows with equal payloads (a null html is an empty one) the one with the largest page_id is a response and the
    others revisit it. Rows that repeat that largest page_id are responses all; a row without page_id is a response.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = page.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest")).where("page_id IS NOT NULL")
    last = digests.groupBy("digest").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("other")).where("other < keep").select("digest", "keep")
    refs = digests.join(last, "digest").where("page_id < keep").select("page_id", "digest", "keep")
    rows = page.select("page_id", F.lit(1).alias("kind"), "url", F.col("html").alias("text"), F.lit(None).cast("long").alias("keep"))
    rows = rows.unionAll(refs.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("text"), "keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, tmp, size, count, files, at, known = None, "", 0, 0, [], None, {}

        def close() -> None:
            nonlocal out, size, count
            out.close()
            name = f"part-{part:05d}-{len(files):05d}.warc.gz"
            fs.move(tmp, f"{base}/{name}")
            files.append((name, count, size))
            out, size, count = None, 0, 0

        for batch in slices(batches):
            for page_id, kind, url, text, keep in zip(*(batch.column(c).to_pylist() for c in ("page_id", "kind", "url", "text", "keep")), strict=True):
                if page_id != at:
                    at, known = page_id, {}
                if kind == 0:
                    known[text] = keep
                    continue
                payload = text.encode()
                if out is None:
                    out = fs.open_output_stream(tmp := f"{base}/{uuid.uuid4().hex}.tmp", compression=None)
                out.write(r := record(page_id, url, payload, known.get(hashlib.sha1(payload).hexdigest()) if known else None))
                size, count = size + len(r), count + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    sorted_ = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "url", "text")
    return table(sorted_.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, file of each record of the manifest's files."""

    def number(name: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for h, block in members(f):
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = int(re.search(r"Content-Length: (\d+)", http.decode())[1])
                        # A response holds its payload, which is counted and hashed anew; a revisit has its headers alone.
                        if h["WARC-Type"] == "response" and (len(body), base32_sha1(body)) != (payload, digest):
                            raise ValueError(f"{name}: a payload differs from its headers")
                        rows.append((number(h["WARC-Record-ID"]), payload, digest, h["WARC-Type"], number(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), name))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"])

    return manifest.select("file").repartition(max(1, min(manifest.count(), 4096)), "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def warc_pages(spark, sf_dir: str) -> DataFrame:
    root = new_dir(spark, "warc")
    manifest = write_warc(load(spark, sf_dir, "pages"), root)
    return read_warc(manifest, root).drop("url", "file")


#: Base32 takes 5 bits a letter, so 5 hex digits are 4 letters.
ORACLE = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < keep THEN keep END AS refers_to
FROM d JOIN l USING (h)
"""
