"""Benchmark decontamination: a BM25 index of test items, block-max pruning, and verified overlap.

Every document is cut into passages of twice the longest item, each half over its neighbour, so an item's words always lie
within one. Each passage queries an inverted index of items: for each term a posting list by item, and the largest impact in
each block of items that it occurs in. A term's impact on an item is its BM25 weight over the item's own threshold: the score
that is left when as many of the item's heaviest terms are lost as shingles may be. So no passage that verification would
confirm scores below 1. A block whose summed maxima don't reach 1 is skipped; only the postings of the others are read. All
passages of a batch advance together, block by block; there is no cursor for each. Retrieved items are verified on 5-word
shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import load, table
from tessera.llm.words import PUNCTUATION, shingle_hashes, slices, text_bytes, word_hashes

K1, B, SHINGLE, OVERLAP = 1.2, 0.75, 5, 0.8
#: Items of a block; items and bytes of their texts in one broadcast index (larger sets of items take several passes). Block
#: maxima that are summed at once.
BLOCK, ITEMS, ITEM_BYTES, AT_ONCE = 16, 2048, 8 << 20, 4 << 20


def lost_shingles(n_words: int) -> int:
    """So many of an item's shingles may be missing, counted in integers: the rest is 0.8 of them or more."""
    n = max(1, n_words - SHINGLE + 1)
    return n - -(-n * round(OVERLAP * 10) // 10)


def _spread(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries of the rows of a compressed table (row r's are ptr[r] to ptr[r + 1]), and whose they are."""
    n = ptr[rows + 1] - ptr[rows]
    own = np.repeat(np.arange(len(rows)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + ptr[rows][own], own


class ItemIndex:
    def __init__(self, ids: list[int], texts: list[str]):
        words, at = word_hashes(*text_bytes(pa.array(texts, pa.string())), PUNCTUATION)
        keep = [i for i in range(len(ids)) if at[i + 1] > at[i]]
        keep.sort(key=lambda i: (at[i + 1] - at[i], ids[i]))
        own = [words[at[i] : at[i + 1]] for i in keep]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.longest = max(map(len, own), default=1)
        self.terms = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        # Postings by term and item: the item's place, how often it has the term, and then the impact.
        code = np.concatenate([np.searchsorted(self.terms, w) * len(own) + j for j, w in enumerate(own)]) if own else np.zeros(0, np.int64)
        code, tf = np.unique(code, return_counts=True)
        term, self.item = (code // max(len(own), 1)).astype(np.int64), (code % max(len(own), 1)).astype(np.int64)
        self.ptr = np.searchsorted(term, np.arange(len(self.terms) + 1))
        n = np.diff(self.ptr)
        idf = np.log1p((len(own) - n + 0.5) / (n + 0.5))
        size = np.array([len(w) for w in own], float)
        bm25 = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.item] / max(size.mean() if own else 1, 1)))
        self.parts, thresholds = [], np.ones(len(own))
        by_item = np.argsort(self.item, kind="stable")
        bounds = np.searchsorted(self.item[by_item], np.arange(len(own) + 1))
        for j, w in enumerate(own):
            cut = len(w) - len(w) // 4 if len(w) >= 4 * SHINGLE else len(w)
            self.parts.append([np.unique(shingle_hashes(p, np.array([0, len(p)]), SHINGLE)[0]) for p in (w, w[:cut], w[cut:] if cut < len(w) else w)])
            mass = np.sort(bm25[by_item[bounds[j] : bounds[j + 1]]])[::-1]
            thresholds[j] = max(mass[lost_shingles(len(w)) :].sum(), 1e-6)
        self.impact = bm25 / thresholds[self.item]
        # The largest impact of each term in each block of items that it occurs in.
        self.blocks = -(-max(len(own), 1) // BLOCK)
        at_block, first = np.unique(term * self.blocks + self.item // BLOCK, return_index=True)
        self.block = at_block % self.blocks
        self.block_ptr = np.searchsorted(at_block // self.blocks, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)

    def _bounds(self, rows: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The summed block maxima of the terms of each of n rows (row of each term given, ascending)."""
        out = np.zeros(n * self.blocks)
        step = max(1, AT_ONCE // self.blocks)
        for a in range(0, len(term), step):
            at, whose = _spread(self.block_ptr, term[a : a + step])
            low = int(rows[a]) * self.blocks
            code = rows[a : a + step][whose] * self.blocks + self.block[at] - low
            sums = np.bincount(code, self.most[at])
            out[low : low + len(sums)] += sums
        return out.reshape(n, self.blocks)

    def retrieve(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, last word, item's place, score) of passages that score 1 or more for an item."""
        if not len(self.terms) or not len(words):
            return
        term = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[term] == words
        half, least = self.longest, 1 - 1e-4
        counts = np.diff(at)
        halves = -(-counts // half)
        first = np.repeat(at[:-1], halves) + half * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
        doc = np.repeat(np.arange(len(counts)), halves)
        hit = np.flatnonzero(known)
        joined = self._bounds(np.searchsorted(first, hit, "right") - 1, term[hit], len(first))
        follows = np.flatnonzero(doc[1:] == doc[:-1])
        joined[follows] += joined[follows + 1]
        ends = np.minimum(first + 2 * half, at[doc + 1])
        for p in np.flatnonzero((joined >= least).any(1)):
            # Terms count once from here on, so fewer blocks are left.
            t = np.unique(term[first[p] : ends[p]][known[first[p] : ends[p]]])
            wanted = (joined[p] >= least) & (self._bounds(np.zeros(len(t), np.int64), t, 1)[0] >= least)
            if wanted.any():
                at_, _ = _spread(self.ptr, t)
                at_ = at_[wanted[self.item[at_] // BLOCK]]
                score = np.bincount(self.item[at_], self.impact[at_])
                for j in np.flatnonzero(score >= least):
                    yield int(doc[p]), int(first[p]), int(ends[p]), int(j), float(score[j])

    def overlaps(self, passage: np.ndarray, item: int) -> tuple[float, float, float]:
        """The share of the whole item's, its question's and its answer's shingles that the passage has.

        The answer is the last quarter of the item's words, the question what comes before; a short item is both.
        """
        own = shingle_hashes(passage, np.array([0, len(passage)]), SHINGLE)[0]
        return tuple(float(np.isin(s, own).mean()) for s in self.parts[item])

    def contaminated(self, words: np.ndarray, at: np.ndarray) -> dict[int, dict[int, tuple[float, float, float, float]]]:
        found: dict[int, dict[int, tuple[float, float, float, float]]] = {}
        for doc, a, b, item, score in self.retrieve(words, at):
            whole, question, answer = self.overlaps(words[a:b], item)
            if whole >= OVERLAP:
                found.setdefault(doc, {})[int(self.ids[item])] = max(found.get(doc, {}).get(int(self.ids[item]), (0.0,) * 4), (whole, question, answer, score))
        return found


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_ids, overlap, question_overlap, answer_overlap, score of rows of docs with a passage of an item.

    A row is contaminated by an item when one of its passages has 0.8 of the item's 5-word shingles; the shares of its
    question's and of its answer's are reported alone. Words are runs of letters and digits, lower-cased (A-Z). Null and
    empty texts on either side match nothing, repeated items count as one. Items are indexed in parts of about ITEMS items and
    ITEM_BYTES of text by a hash of their id, so that what is broadcast is bounded; with more parts than one, docs is read once
    for each, and rows of one doc_id count as one.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    schema = "doc_id long, item_ids array<long>, overlap double, question_overlap double, answer_overlap double, score double"
    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast(ItemIndex(own["item_id"].to_pylist(), own["text"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=2 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for d, hits in sorted(sent.value.contaminated(*word_hashes(*text_bytes(batch.column("text")), PUNCTUATION)).items()):
                    rows.append((ids[d], sorted(hits), *max(hits.values())))
                kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_ids", "overlap", "question_overlap", "answer_overlap", "score"])

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    if blocks == 1:
        return parts[0]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = F.max(F.struct("overlap", "question_overlap", "answer_overlap", "score")).alias("best")
    return table(found, "leaks").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best).select("doc_id", "item_ids", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has no leak; rows without doc_id stay."""
    gone = table(leaks(docs, items).select("doc_id").where("doc_id IS NOT NULL").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def leaks_of(spark, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
