"""Toxicity: FTRL-proximal logistic regression over hashed words, pairs and skip-pairs.

A text's features are the distinct hashes of its words, of neighbouring word
pairs and of pairs with one word between. Learning rates are per coordinate and
L1 leaves few weights, which are sent to the executors as (index, weight) pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.textmap import per_text
from presswork.llm.wordhash import U, chunks, mix, word_hashes
from presswork.session import bound_batches

#: Hashed feature space; also the bound on the number of weights.
BITS = 20
#: The classifier is fitted on about so many labelled rows at most, taken by a hash of the id.
MAX_TRAINING_ROWS = 30_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 1.0, 3
#: A document counts as toxic from this score on.
THRESHOLD = 0.3


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers (below 2**BITS) of each text; none for a text without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    with np.errstate(over="ignore"):
        for start, end in chunks(raw):
            hashes, first = word_hashes(raw[start:end])
            for i in range(end - start):
                w = hashes[first[i] : first[i + 1]]
                pairs, skips = mix(w[:-1] * U(3) + w[1:] * U(5) + U(1)), mix(w[:-2] * U(3) + w[2:] * U(5) + U(2))
                yield np.unique((np.concatenate([w, pairs, skips]) >> U(64 - BITS)).astype(np.uint32))


def split_key(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a NULL id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(0))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights) that are not zero after FTRL-proximal passes over the rows; number 2**BITS is the intercept, which L1 spares."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for f, label in rows:
            at = np.append(f, size)
            w = _weights(z[at], n[at])
            w[-1] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = _weights(z, n)
    w[size] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
    at = np.flatnonzero(w)
    return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2, modulus: int = 4, max_rows: int = MAX_TRAINING_ROWS) -> dict[int, float]:
    """Weights learned from labelled documents outside the held-out fold.

    Rows whose crc32(id as text) mod ``modulus`` is ``held_out`` are never
    learned from. About ``max_rows`` labels at most are used, by a hash of the
    id, so the fit is the same on every run and bounded at every size. NULL ids
    and NULL labels are left out; of several labels of an id the largest counts.
    Without labelled rows the result is empty.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    usable = usable.where(split_key("id", modulus) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(1, usable.count()))
    order = F.pmod(F.xxhash64("id", F.lit(20)), F.lit(1 << 30))
    sample = usable.withColumn("at", order).where(F.col("at") < int(share * (1 << 30)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                f = pa.array([x.tobytes() for x in features(part.column("text").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("label"), f], names=["at", "label", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:  # features stay in the batches, and are not copied
            f = b.column("f")
            data, at = np.frombuffer(f.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(f.buffers()[1], dtype=np.int32)[f.offset : f.offset + len(f) + 1]
            rows += [(order, label, data[i:j].view(np.uint32)) for order, label, i, j in zip(b.column("at").to_pylist(), b.column("label").to_pylist(), at.tolist(), at[1:].tolist(), strict=False)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), zlib.crc32(r[2])))  # the same order on every run
        at, w = ftrl([(f, label) for _, label, f in rows]) if rows else (np.zeros(0, int), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["feature", "weight"])

    bound_batches(docs.sparkSession)
    # The sample is bounded by max_rows, so it can be broadcast and learned from in one task.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("at", "label", "text")
    learned = rows.mapInArrow(hashed, "at long, label int, f binary").repartition(1).mapInArrow(learn, "feature long, weight double")
    return {r["feature"]: r["weight"] for r in learned.collect()}


def score(docs: DataFrame, weights: dict[int, float], text_col: str = "text") -> DataFrame:
    """Rows of two columns: ``row`` (a struct of all columns of the document) and ``score``.

    The score is the probability of label 1, from the text alone; a NULL or
    empty text scores by the intercept. Without weights every score is 0.
    """
    at = np.array(list(weights), dtype=np.int64)
    values = np.array(list(weights.values()))
    sent = docs.sparkSession.sparkContext.broadcast((at, values))  # at most 2**BITS + 1 pairs

    def make() -> Callable[[list[str | None]], pa.Array]:
        at, values = sent.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = values

        def work(texts: list[str | None]) -> pa.Array:
            sums = np.array([dense[f].sum() + dense[-1] for f in features(texts)])
            return pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))) if len(at) else np.zeros(len(texts)), pa.float64())

        return work

    return docs.select(F.struct("*").alias("row"), per_text(docs.sparkSession, make, "double")(F.col(text_col)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``held_out`` (not learned from), ``score`` and ``predicted`` of every row of ``docs``.

    Whole texts are read, however long; a NULL or empty text scores by the
    intercept. Repeated rows are scored each; a row without id counts as not held
    out. Only the named columns matter, whatever others are called. An empty table
    gives no rows; without labels every score is 0.
    """
    weights = fit(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), weights)
    return scored.select(
        F.col("row.id").alias(id_col), (split_key(F.col("row.id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns as they were.

    Columns may have any names. Each row is judged by its own text: repeated rows
    stay or go together, NULL and empty texts go by the intercept (a rare label
    keeps them). Without labels, or in an empty table, nothing is rejected.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col)
    return scored.where(F.col("score") < threshold).select("row.*")
