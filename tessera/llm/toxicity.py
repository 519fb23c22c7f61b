"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import load
from tessera.llm.words import PUNCTUATION, U, mix, slices, text_bytes, word_hashes

#: Features are hashed to 2**BITS coordinates; SAMPLE bounds the labelled rows that the model is fitted on.
BITS, SAMPLE, EPOCHS = 20, 8192, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.01
THRESHOLD = 0.7


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct coordinates of each text's words, word pairs and pairs with one word between; and where they begin."""
    w, at = word_hashes(data, off, PUNCTUATION)
    n = len(w)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(U)
    parts, docs = [w], [doc]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xE220A8397B1DCDAF)):
        i = np.flatnonzero(left > gap)
        parts.append(mix(w[i] * U(salt) + w[i + gap]))
        docs.append(doc[i])
    code = np.concatenate(docs) << U(BITS) | (np.concatenate(parts) >> U(64 - BITS))
    code.sort()
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if n else code
    starts = np.searchsorted(code, np.arange(len(at), dtype=U) << U(BITS))
    return (code & U((1 << BITS) - 1)).astype(np.int32), starts


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal weights: per-coordinate rates from the sums of squared gradients, and L1 that leaves most at zero.

    The last coordinate (beyond the hashed ones) is the intercept, without L1.
    """
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        lasso = np.where(i == 1 << BITS, 0.0, l1)
        return np.where(np.abs(zi) <= lasso, 0.0, (np.sign(zi) * lasso - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r], 1 << BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            n1 = n[i] + g * g
            z[i] += g - (np.sqrt(n1) - np.sqrt(n[i])) / alpha * w
            n[i] = n1
    return weights(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero coordinates and their weights, fitted on at most `sample` labelled documents.

    The rows are those with the smallest md5 of their doc_id among labelled ones whose crc32(doc_id as text) mod 3 is not 1;
    nulls in doc_id or toxic take no part, and of rows that repeat a doc_id the smallest text does. Only this bounded sample's coordinates reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            code, at = features(*text_bytes(batch.column("text")))
            sets = [code[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary()), batch.column("toxic")], ["doc_id", "code", "toxic"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")  # one row for each id
    got = own.mapInArrow(run, "doc_id long, code binary, toxic int").toArrow().sort_by([("doc_id", "ascending"), ("code", "ascending")])
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got["code"]]
    w = fit(rows, got["toxic"].to_numpy().astype(float))
    at = np.flatnonzero(w)
    return at, w[at]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "score") -> DataFrame:
    """docs with a toxicity score from 0 to 1; a null or empty text has the intercept's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in slices(batches):
            code, at = features(*text_bytes(batch.column("text")))
            sums = np.concatenate([[0.0], np.cumsum(w[code])])
            p = 1 / (1 + np.exp(-np.clip(sums[at[1:]] - sums[at[:-1]] + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; held_out is null where doc_id is."""
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns."""
    free = next(c for c in (f"_score{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    return score(docs, train(docs, labels), free).where(F.col(free) < threshold).drop(free)


def toxicity_of(spark, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
