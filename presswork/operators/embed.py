"""Texts as vectors: hashed TF-IDF, reduced by a randomised singular value decomposition.

The words of a text become bucket numbers in the JVM. The table of texts is only
ever multiplied: tasks hold the two matrices of BUCKETS rows and a few columns
that subspace iteration needs, and return partial sums of the same size. So the
driver sees matrices whose size depends on the buckets and on the number of
dimensions, and never on the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import bound_batches, settle

#: Hashed vocabulary.
BUCKETS = 1 << 13
#: Further columns and rounds of the subspace iteration; both make the leading directions more exact.
MORE, ROUNDS = 12, 3


def buckets(text: str | Column, n: int = BUCKETS, stop_words: tuple[str, ...] = ()) -> Column:
    """The bucket of every word of two letters or more (repeats stay), case ignored; empty for NULL."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct buckets of each text in ascending order, and how often each occurs."""
    for b in batches:
        ends = b.offsets.to_numpy()
        sizes = np.diff(ends)
        keys = np.repeat(np.arange(len(b), dtype=np.int64), sizes) << 32 | b.values.to_numpy()[ends[0] : ends[-1]]
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        cuts = pa.array(np.searchsorted(keys[first] >> 32, np.arange(len(b) + 1)), pa.int32())
        at, tf = (keys[first] & 0xFFFFFFFF).astype(np.int32), np.diff(first, append=len(keys)).astype(np.int32)
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(at)), pa.ListArray.from_arrays(cuts, pa.array(tf))], names=["at", "tf"])


def counted(text: str | Column, n: int = BUCKETS, stop_words: tuple[str, ...] = ()) -> Column:
    """struct(at, tf) of a text: its distinct buckets and how often each occurs."""
    return F.arrow_udf(_counted, "struct<at: array<int>, tf: array<int>>")(buckets(text, n, stop_words))


def _parts(words: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the texts begin and end, and the buckets and counts of all of them."""
    at, tf = words.field("at"), words.field("tf")
    ends = at.offsets.to_numpy()
    return ends - ends[0], at.flatten().to_numpy(), tf.flatten().to_numpy()


def _rows(words: pa.StructArray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: (1 + ln tf) * idf, of unit length; a text without words has none."""
    ends, at, tf = _parts(words)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        w = (1 + np.log(tf[a:b])) * idf[at[a:b]]
        yield at[a:b], w / (np.sqrt((w * w).sum()) or 1.0)


#: Texts that are multiplied at a time, over the buckets that occur in them.
TEXTS = 16


def _sums(sent: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """This task's part of A^T (A M), by bucket, for the sent idf and M."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, m = sent.value
        total = np.zeros_like(m)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                ends, at, tf = _parts(b.column("w").slice(i, TEXTS))
                row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                w = (1 + np.log(tf)) * idf[at]
                w /= np.sqrt(np.bincount(row, w * w, len(ends) - 1))[row]
                here = np.zeros(len(idf), bool)
                here[at] = True
                hit = np.flatnonzero(here)
                a = np.zeros((len(ends) - 1, len(hit)))
                a[row, (np.cumsum(here) - 1)[at]] = w
                total[hit] += a.T @ (a @ m[hit])
        hit = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(hit), 512):
            part = hit[i : i + 512]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([r.tobytes() for r in total[part]], pa.binary())], names=["bucket", "sums"])

    return work


def _added(p: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of the parts of each bucket; a bucket's parts lie in one task, which holds one row for each of its buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column("bucket").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(s)
                total[k] = total[k] + x if k in total else x
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["bucket", "sums"])

    return work


class Embedding:
    """A fitted reduction: ``idf`` of every bucket, ``directions`` (BUCKETS x dims), and the singular values."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, values: np.ndarray, stop_words: tuple[str, ...] = ()) -> None:
        self.idf, self.directions, self.values, self.stop_words = idf, directions, values, stop_words

    def apply(self, docs: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """``docs`` with the vector of every text; a text without known words, or NULL, has zeros."""
        bound_batches(docs.sparkSession)
        return docs.withColumn(name, self._vector(docs.sparkSession, counted(text, len(self.idf), self.stop_words)))

    def _vector(self, spark: SparkSession, words: Column) -> Column:
        sent = spark.sparkContext.broadcast((self.idf, self.directions))  # BUCKETS x dims

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            idf, v = sent.value
            for b in batches:
                out = np.array([w @ v[at] for at, w in _rows(b, idf)]).reshape(-1, v.shape[1])
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * v.shape[1], pa.int32()), pa.array(out.ravel()))

        return F.arrow_udf(run, "array<double>")(words)


def fit(docs: DataFrame, dims: int = 50, text: str = "text", n: int = BUCKETS, stop_words: tuple[str, ...] = (), seed: int = 11) -> Embedding:
    """Learn a reduction from all texts: document counts of buckets, then ROUNDS of subspace iteration and one of Rayleigh-Ritz.

    The words of all texts are written once, as counts by bucket, and read in every
    round. Texts without words count as documents and add nothing else.
    """
    bound_batches(docs.sparkSession)
    return _fitted(settle(docs.select(counted(text, n, stop_words).alias("w")), "words"), dims, n, stop_words, seed)


def fit_apply(docs: DataFrame, dims: int = 50, text: str = "text", n: int = BUCKETS, stop_words: tuple[str, ...] = (), seed: int = 11, name: str = "embedding") -> DataFrame:
    """What ``fit(docs).apply(docs)`` returns, without the text; the texts are cut into words a single time."""
    bound_batches(docs.sparkSession)
    words = settle(docs.withColumn("w", counted(text, n, stop_words)).drop(text), "words")
    made = _fitted(words, dims, n, stop_words, seed)._vector(docs.sparkSession, F.col("w"))
    return words.withColumn(name, made).drop("w")


def _fitted(words: DataFrame, dims: int, n: int, stop_words: tuple[str, ...], seed: int) -> Embedding:
    spark = words.sparkSession
    width = min(dims + MORE, n)
    words = words.select("w")
    count = words.count()
    df = words.select(F.explode("w.at").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).collect()  # at most n rows
    idf = np.zeros(n)
    for r in df:
        idf[r["bucket"]] = np.log((1 + count) / (1 + r["df"])) + 1
    m = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    dealt = words.coalesce(4 * spark.sparkContext.defaultParallelism)  # each task returns up to n rows, however many texts it has
    for step in range(ROUNDS + 1):
        sent = spark.sparkContext.broadcast((idf, m))
        parts = dealt.mapInArrow(_sums(sent), "bucket long, sums binary").repartition(16, "bucket").mapInArrow(_added(width), "bucket long, sums binary")
        z = np.zeros_like(m)
        for r in parts.collect():  # at most n rows of ``width`` numbers
            z[r["bucket"]] = np.frombuffer(r["sums"])
        if step < ROUNDS:
            m = np.linalg.qr(z)[0]
    squares, turn = np.linalg.eigh(m.T @ z)  # of A restricted to the subspace
    order = np.argsort(-squares)[:dims]
    directions = m @ turn[:, order]
    directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # of two signs the one with the greatest entry positive
    return Embedding(idf, directions, np.sqrt(np.maximum(0, squares[order])), stop_words)
