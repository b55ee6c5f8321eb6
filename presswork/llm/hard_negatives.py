"""Hard negatives by Fagin's threshold algorithm.

Candidates lie in chunks; a chunk has a sorted list of its rows for every
dimension. For an anchor the lists are read from the end that its sign asks for,
rows are scored in full when they are first met, and reading stops as soon as
the threshold (what a row not yet met can score at most) is strictly below the
k-th score of every window that is asked for. A task reads its chunks one after
the other and keeps what it has found, so later chunks stop earlier. Anchors are
a stated query set: they go out in blocks of bounded size, one pass over the
candidates a block, and each task returns its best rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import settle, tidy

#: Rows of a chunk.
CHUNK = 8192
#: Anchors of a block, and bytes of their vectors, at most (but for chance: blocks are dealt by hash).
ANCHORS, ANCHOR_BYTES = 16_384, 8 << 20
#: Rows read from each list before the threshold is first tried, and how much deeper each further round reads.
FIRST, DEEPER = 32, 4
#: Components are integers of 32 bits.
LIMIT = 1 << 31
#: Integers below this are exact as doubles.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Lists:
    """Rows of one chunk with a list of them for every dimension, in the order of that component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        self.ids, self.rows, self.labels = ids, rows, labels
        self.n, self.most = len(vectors), int(np.abs(vectors).sum(axis=1).max()) if vectors.size else 0
        self.vectors = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.vectors, self.order.T, axis=0).T

    def _times(self, x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, as integers; one beyond 64 bits is the nearest that has 64."""
        if self.most * int(np.abs(anchor).max(initial=0)) < EXACT:
            return (x @ anchor.astype(np.float64)).astype(np.int64)
        return np.array([min(MOST, max(LEAST, v)) for v in x.astype(np.int64).astype(object) @ anchor.astype(object)], dtype=np.int64)

    def threshold(self, anchor: np.ndarray, depth: int) -> int:
        """What a row that is deeper than ``depth`` in every list can score at most."""
        best = np.where(anchor >= 0, self.sorted[:, self.n - 1 - depth], self.sorted[:, depth])
        return int(self._times(best[None, :], anchor)[0])

    def search(self, anchor: np.ndarray, found: Found, allowed: np.ndarray | None) -> int:
        """Add this chunk's rows to what was found for an anchor; returns the number of rows that were scored."""
        falling = anchor >= 0
        met = np.zeros(self.n, dtype=bool)
        depth, scored = 0, 0
        while depth < self.n and self.threshold(anchor, depth) >= found.floor():
            deep = min(self.n, max(FIRST, depth * DEEPER))
            now = np.zeros(self.n, dtype=bool)
            now[self.order[falling, self.n - deep : self.n - depth].ravel()] = True
            now[self.order[~falling, depth:deep].ravel()] = True
            if deep == self.n:
                now[:] = True
            fresh = np.flatnonzero(now & ~met)
            met |= now
            depth, scored = deep, scored + len(fresh)
            scores = self._times(self.vectors[fresh], anchor)
            if allowed is not None:
                scores, fresh = scores[allowed[fresh]], fresh[allowed[fresh]]
            found.add(scores, self.ids[fresh], self.rows[fresh])
        return scored


class Found:
    """The first k rows (by score falling, then id) in each of an anchor's score windows."""

    def __init__(self, windows: list[tuple[int, int]], k: int) -> None:
        self.k = k
        self.windows = [w for w in windows if w[0] <= w[1]]
        self.best = [tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) for _ in self.windows]

    def _floor(self, w: int) -> int:
        """A row below this score does not enter the window."""
        scores = self.best[w][0]
        return max(self.windows[w][0], int(scores[-1])) if len(scores) >= self.k else self.windows[w][0]

    def floor(self) -> float:
        return min((self._floor(w) for w in range(len(self.windows))), default=np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for w, (_, high) in enumerate(self.windows):
            at = np.flatnonzero((scores >= self._floor(w)) & (scores <= high))
            if len(at) > 4 * self.k:  # ties at the k-th score stay
                least = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
                at = at[scores[at] >= least]
            if len(at):
                s, i, r = (np.concatenate([old, new[at]]) for old, new in zip(self.best[w], (scores, ids, rows), strict=True))
                first = np.lexsort((r, i, -s.astype(np.float64) if np.abs(s).max() < EXACT else ~s))[: self.k]
                self.best[w] = (s[first], i[first], r[first])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    kept: list[pa.RecordBatch] = []
    for b in batches:
        for start in range(0, b.num_rows, CHUNK):
            kept.append(b.slice(start, CHUNK))
            if sum(x.num_rows for x in kept) >= CHUNK:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _by_length(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, vectors, ids, rows, labels) of the rows that have vectors of one length."""
    column = t.column("v").combine_chunks()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(ends)
    ids, rows, labels = (t.column(c).to_numpy() for c in ("id", "row", "label"))
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), flat[ends[at][:, None] + np.arange(d)[None, :]], ids[at], rows[at], labels[at]


OUT = "anchor long, window long, score long, id long, row long"


def _searcher(anchors: object, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over candidates. ``anchors`` sends (rows, labels, vectors, windows by name) of a block; same: rows of the anchor's label, else of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Found(list(w.values()), k) for _, _, _, w in anchors.value]
        for chunk in _chunks(batches):
            for d, vectors, ids, rows, labels in _by_length(chunk):
                whole = None if same else Lists(vectors, ids, rows, labels)
                of: dict[int, Lists] = {}
                for (row, label, vector, _), f in zip(anchors.value, found, strict=True):
                    if len(vector) != d or not f.windows:
                        continue
                    if same:
                        if label not in of:
                            at = labels == label
                            of[label] = Lists(vectors[at], ids[at], rows[at], labels[at])
                        of[label].search(vector, f, of[label].rows != row)
                    else:
                        whole.search(vector, f, whole.labels != label)
        for (row, _, _, windows), f in zip(anchors.value, found, strict=True):
            names = [n for n, w in windows.items() if w[0] <= w[1]]
            for name, (s, i, r) in zip(names, f.best, strict=True):
                if len(s):
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array(s), pa.array(i), pa.array(r)], names=["anchor", "window", "score", "id", "row"])

    return run


def _first(candidates: DataFrame, tasks: int, block: list, k: int, same: bool) -> DataFrame:
    """anchor, window, score, id, row, rank: the first k rows in each window of each anchor of the block."""
    sent = candidates.sparkSession.sparkContext.broadcast(block)  # bounded by ANCHORS and ANCHOR_BYTES
    best = candidates.repartition(tasks).mapInArrow(_searcher(sent, k, same), OUT)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integers(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL where the vector is NULL or has a component that is NULL, not finite, or beyond 32 bits."""
    c = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | ~(F.abs(x.cast("double") * scale) < LIMIT))
    return F.when(~bad, F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("int")))


@tidy("negatives")
def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Negatives of every anchor and positive: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Scores are exact inner products of the components scaled by 256 and rounded
    down; higher ones come first, ties by the smaller id. An anchor's positives
    are its first ``positives`` other rows of the same label. Each has the first
    ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` per cent of the positive's (a negative positive score has none).

    Rows take no part whose id, label or vector is NULL, or that have a component
    that is NULL, not finite, or too large for 32 bits after scaling. Vectors of
    different lengths are not compared; those of length 0 score 0. Repeated rows
    are rows of their own, as anchors too. Only the named columns are read. An
    empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(vec_col).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = settle(rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "vectors")
    candidates, asked = rows.select("id", "label", "v", "row"), rows.where("anchor").select("id", "label", "v", "row")
    n = rows.count()
    tasks = max(1, min(-(-n // CHUNK), 4 * spark.sparkContext.defaultParallelism))
    m, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v") * 4), F.lit(0))).first()
    blocks = max(-(-m // ANCHORS), -(-size // ANCHOR_BYTES), 1)
    out = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        block = [(row, label, v) for _, v5, _, r5, l5 in _by_length(own.toArrow()) for row, label, v in zip(r5.tolist(), l5.tolist(), v5, strict=True)]
        near = settle(_first(candidates, tasks, [(r, c, v, {0: (LEAST, MOST)}) for r, c, v in block], positives, True), "positives")
        scores: dict[int, set[int]] = {}
        for r in near.select("anchor", "score").collect():  # at most ``positives`` an anchor of the block
            scores.setdefault(r["anchor"], set()).add(r["score"])
        windows = [(r, c, v, {s: (-(-low * s // 100), high * s // 100) for s in sorted(scores.get(r, ()))}) for r, c, v in block]
        far = settle(_first(candidates, tasks, windows, negatives, False), "mined")
        pairs = near.select("anchor", F.col("score").alias("window"), F.col("id").alias("positive_id"))
        mined = far.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "window"])
        out.append(mined.join(own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"))
    found = reduce(DataFrame.unionByName, out)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", F.col("window").alias("positive_score"), "negative_score")


def mined_sql() -> str:
    """The contract of op11 in DuckDB SQL, by all inner products."""
    return """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
