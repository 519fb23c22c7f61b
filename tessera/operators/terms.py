"""Phrases inside texts, and words resolved against a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import norm, split_multi

#: Letters of all phrases up to which they are sent to every task as one automaton; beyond that phrases are joined by runs of letters.
SENT = 1_000_000
#: How a term stands for an id, surest first.
PRECEDENCE = ["id", "label", "alternative", "old", "contained"]

_built: dict[int, ahocorasick.Automaton] = {}


def _automaton(sent) -> ahocorasick.Automaton:
    """The automaton of a broadcast's phrases, built once in each Python worker."""
    if sent.value[0] not in _built:
        own = ahocorasick.Automaton()
        for phrase in sent.value[1]:
            own.add_word(phrase, phrase)
        own.make_automaton()
        _built.clear()
        _built[sent.value[0]] = own
    return _built[sent.value[0]]


def contained(texts: DataFrame, phrases: DataFrame, sent: int = SENT) -> DataFrame:
    """id, p, at: every phrase p of phrases (p) inside a text of texts (id, t), once a text, with the place (from 0) of its first occurrence.

    Nulls and empty phrases are left out; ids may repeat. Up to `sent` letters of distinct phrases one automaton goes over each text in
    one pass. More of them meet the texts by that run of letters of a phrase which fewest other phrases have.
    """
    own = phrases.where(F.length("p") > 0).select("p").distinct()
    size = own.agg(F.sum(F.length("p")).alias("letters"), F.count("*").alias("n")).first()
    texts = texts.select("id", "t").where("t IS NOT NULL")
    if not size.n:
        return texts.limit(0).select("id", F.col("t").alias("p"), F.lit(0).alias("at"))
    return _scanned(texts, own) if size.letters <= sent else _joined(texts, own)


def _scanned(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    words = sorted(r.p for r in phrases.collect())
    sent = texts.sparkSession.sparkContext.broadcast((hash(tuple(words)), words))
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(sent)
        for batch in batches:
            rows, phrase, at = [], [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                first: dict[str, int] = {}
                for end, p in found.iter(text):
                    first.setdefault(p, end - len(p) + 1)
                rows += [i] * len(first)
                phrase += first
                at += first.values()
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(phrase, pa.string()), pa.array(at, pa.int32())], ["id", "p", "at"])

    return texts.mapInArrow(run, f"id {kind}, p string, at int")


def _joined(texts: DataFrame, phrases: DataFrame, run: int = 5) -> DataFrame:
    """By runs of letters; phrases shorter than `run` are few (there aren't more of them than runs) and keep a join of their own length."""
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))
    out = []
    for n in range(1, run + 1):
        own = phrases.where(F.length("p") >= n if n == run else F.length("p") == n)
        each = own.select("p", F.explode(runs("p", n)).alias("g"))
        rarest = each.join(each.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("p").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
        met = texts.where(F.length("t") >= n).select("id", "t", F.explode(runs("t", n)).alias("g")).join(rarest, "g")
        out.append(met.where(F.contains("t", F.col("p"))).select("id", "p", (F.position("p", "t") - 1).alias("at")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def vocabulary(terms: DataFrame) -> DataFrame:
    """term (normalised), id, how: each term once, for the surest of its ids; of equally sure ones the smallest.

    terms: id, label, alternatives and old (arrays of further spellings, which may be null). An id, a label, the label without what
    stands in brackets, and the spellings are terms.
    """
    rows = [terms.select(F.col("id").alias("t"), "id", F.lit("id").alias("how")), terms.select(F.col("label").alias("t"), "id", F.lit("label").alias("how"))]
    rows += [terms.select(F.explode(c).alias("t"), "id", F.lit(how).alias("how")) for c, how in (("alternatives", "alternative"), ("old", "old"))]
    rows.append(terms.select(F.regexp_replace("label", r"\s*\([^)]*\)\s*", " ").alias("t"), "id", F.lit("old").alias("how")))
    each = rows[0]
    for more in rows[1:]:
        each = each.unionByName(more)
    each = each.withColumn("term", norm(F.col("t"))).where("term <> ''")
    return each.groupBy("term").agg(F.min(F.struct(_rank("how").alias("k"), "id", "how")).alias("b")).select("term", "b.id", "b.how")


def _rank(c: str):
    return F.coalesce(*[F.when(F.col(c) == v, i) for i, v in enumerate(PRECEDENCE)])


def resolve_terms(df: DataFrame, id: str, col: str, vocab: DataFrame, pattern: str = r"\s*[|;/]\s*|\s*,\s*(?![^()]*\))", inside: bool = True, least: int = 4) -> DataFrame:
    """id, part, n, term_id, how for each distinct part of a multi-value cell, in order (n from 0); term_id and how are null for unknown parts.

    vocab: an answer of `vocabulary`. A part is looked up whole; with `inside`, one that isn't found takes the longest term of
    `least` letters or more inside it, on ties the first in the text, and then the smaller term.
    """
    cells = df.select(F.col(id).alias("id"), F.posexplode(split_multi(F.col(col), pattern)).alias("n", "part")).withColumn("k", norm(F.col("part")))
    parts = cells.select("k").distinct()
    whole = parts.join(vocab, F.col("k") == F.col("term")).select("k", F.col("id").alias("term_id"), "how")
    if inside:
        rest = parts.join(whole.select("k"), "k", "left_anti")
        hits = contained(rest.select(F.col("k").alias("id"), F.col("k").alias("t")), vocab.where(F.length("term") >= least).select(F.col("term").alias("p")))
        best = hits.groupBy(F.col("id").alias("k")).agg(F.min(F.struct((-F.length("p")).alias("l"), "at", "p"))["p"].alias("term"))
        whole = whole.unionByName(best.join(vocab, "term").select("k", F.col("id").alias("term_id"), F.lit("contained").alias("how")))
    return cells.join(whole, "k", "left").select(F.col("id").alias(id), "part", "n", "term_id", "how")


def unknown_terms(resolved: DataFrame) -> DataFrame:
    """part, n: how many cells have a part that the vocabulary doesn't know, most often first where they are ordered by n."""
    return resolved.where("term_id IS NULL").groupBy("part").agg(F.count("*").alias("n"))


def longest_matches(texts: DataFrame, id: str, col: str, vocab: DataFrame) -> DataFrame:
    """id, start, end, term, term_id of the vocabulary's terms in free text: from the left, at each place the longest, whole words only.

    Places count the characters of the text with its spaces collapsed and in lower case; a term begins and ends at a word's edge. Matches
    don't overlap. The vocabulary goes to every task and must have at most SENT letters.
    """
    if (vocab.agg(F.sum(F.length("term"))).first()[0] or 0) > SENT:
        raise ValueError("the vocabulary is too large for free text: use resolve_terms or contained")
    words = {r.term: r.id for r in vocab.select("term", "id").collect()}
    kind = dict(texts.dtypes)[id]
    if not words:
        return texts.limit(0).select(F.col(id), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("term"), F.lit("").alias("term_id"))
    sent = texts.sparkSession.sparkContext.broadcast((hash(tuple(sorted(words))), sorted(words), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(sent)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                edge = lambda k: k == 0 or k == len(text) or not (text[k - 1].isalnum() and text[k].isalnum())  # noqa: B023, E731
                spans = sorted((end - len(p) + 1, -len(p), p) for end, p in found.iter(text or "") if edge(end + 1) and edge(end - len(p) + 1))
                done = 0
                for start, size, p in spans:
                    if start >= done:
                        rows.append(i)
                        out.append((start, start - size, p, sent.value[2][p]))
                        done = start - size
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *cols], [id, "start", "end", "term", "term_id"])

    return texts.select(F.col(id).alias("id"), norm(F.col(col)).alias("t")).mapInArrow(run, f"`{id}` {kind}, start int, end int, term string, term_id string")
