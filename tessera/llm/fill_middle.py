"""Fill-in-middle rows: texts cut into prefix, middle and suffix, put in another order behind sentinels, and rebuilt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load
from tessera.llm.words import slices

#: A unit over UTF-8 bytes: a run of letters, any other ASCII character, or the bytes of one code point beyond ASCII.
UNIT = rb"([A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*)"
#: A byte that UTF-8 never has.
END = b"\xff"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in hundredths, of texts that are reordered, and of those with the suffix first.
RATE, SPM = 90, 20


def _joining(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts), pa.scalar("", pa.large_string()))


def _mod(a, b):
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def pieces(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The number of units of each text, and its prefix, middle and suffix as the draws h1 and h2 cut it."""
    units = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_binary()), UNIT, rb"\1" + END), END)
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)  # an empty one follows the last END
    a, b = (_mod(h, pc.add(n, 1)) for h in (h1, h2))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(units.offsets.cast(pa.int64()), parent))
    first, middle = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    last = pc.and_not(pc.less(ordinal, pc.take(n, parent)), middle)
    roles = ((first, low), (pc.and_not(middle, first), pc.subtract(high, low)), (last, pc.subtract(n, high)))
    return n, *(_joined(pc.filter(flat, role), counts) for role, counts in roles)


def _joined(units: pa.Array, counts: pa.Array) -> pa.Array:
    """The units, of which each row has so many, joined to one text a row."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])
    return pc.binary_join(pa.ListArray.from_arrays(offsets.cast(pa.int32()), units), pa.scalar(b"", pa.large_binary())).cast(pa.large_string())


def _form(texts: pa.Array, h3: pa.Array, h4: pa.Array, rate: int, spm: int) -> pa.Array:
    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(_mod(h3, 100), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    return pc.if_else(plain, "plain", pc.if_else(pc.less(_mod(h4, 100), spm), "spm", "psm"))


def fill_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars for each row of docs (doc_id, text; other columns aren't read).

    The draws are the first four 8-digit groups of sha256 of "seed:doc_id", so a row's answer depends on its id and text alone;
    rows that repeat an id are cut by the same draws, and a null id draws as the empty text. A null text is an empty one, an
    empty text and one that holds a sentinel stay plain. Prefix, middle or suffix may be empty. Batches are cut into runs of
    about 4 MB of text; a longer text is a run of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            h = [batch.column(f"h{i}") for i in range(1, 5)]
            n, prefix, middle, suffix = pieces(texts, h[0], h[1])
            form = _form(texts, h[2], h[3], rate, spm)
            psm = _joining(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
            changed = _joining(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
            output = pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "psm"), psm, changed))
            null = pa.scalar(None, pa.int64())
            sizes = [pc.if_else(pc.equal(form, "plain"), null, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, output.cast(pa.string()), *sizes], ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws)
    return rows.mapInArrow(run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs of these forms come from. No sentinel overlaps another, so the first of each kind is the one put in."""
    moved = pc.not_equal(form, "plain")
    rows, first = pc.filter(output, moved), pc.equal(pc.filter(form, moved), "psm")
    ends = pc.split_pattern(pc.utf8_slice_codeunits(rows, 3), MIDDLE, max_splits=1)
    head, middle = pc.list_element(ends, 0), pc.list_element(ends, 1)
    halves = [pc.split_pattern(head, mark, max_splits=1) for mark in (SUFFIX, PREFIX)]
    texts = []
    for psm, halves_of in ((True, halves[0]), (False, halves[1])):
        keep = first if psm else pc.invert(first)
        one = pc.filter(halves_of, keep)
        a, b = pc.list_element(one, 0), pc.list_element(one, 1)
        prefix, suffix = (a, b) if psm else (b, a)
        texts.append(_joining(prefix, pc.filter(middle, keep), suffix))
    order = pa.array(np.argsort(np.concatenate([np.flatnonzero(pc.equal(first, x).to_numpy(zero_copy_only=False)) for x in (True, False)])))
    return pc.replace_with_mask(output, moved, pc.take(pa.concat_arrays(texts), order))


def restored(rows: DataFrame) -> DataFrame:
    """The rows of `fill_middle` with `restored`, the text rebuilt from output and form alone."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "restored string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            text = rebuilt(batch.column("output").cast(pa.large_string()), batch.column("form"))
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*batch.schema.names, "restored"])

    return rows.mapInArrow(run, schema)


def fill_middle_of(spark, sf_dir: str) -> DataFrame:
    rows = restored(fill_middle(load(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
v AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
