"""Sharding by histogram sort: exact byte counts below candidate boundaries,
refined until every splitter is close enough, then one exchange.

The key of a row is (hash of its text, id), so equal texts are neighbours and
part only where a boundary would fall inside a class of copies that is too large
to go to one side. Shards are key ranges of near-equal bytes. They are cut into
pieces of near-equal numbers of rows, also inside a class of equal texts, so that no
task ever holds a whole shard, or a class of very many short texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import settle, tidy

#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.001
#: A class of equal texts of up to this share of a shard's bytes is never parted: the boundary goes to its nearer edge.
PART_SHARE = 0.02
#: Bytes of a piece's narrow rows, which one task sorts, at ROW_BYTES each; with more than MAX_PIECES pieces they become larger.
PIECE_BYTES, ROW_BYTES, MAX_PIECES = 256 << 20, 64, 1 << 14
#: Candidate boundaries put into each open bracket in each round.
PROBES = 255
#: Boundaries counted in one round over all brackets (the driver gets at most 32 bytes for each); with very many targets each bracket gets fewer, or waits for a later round, and rounds become more.
MAX_PROBES = 1 << 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sized(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Narrow rows: id, key hash, size (UTF-8 bytes plus 1; 1 for NULL), CRC-32."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), *carry)


def _histogram(rows: DataFrame, column: str, cuts: list[int], within: int | None = None) -> dict[int, int]:
    """Exact bytes of the rows whose ``column`` is less than each cut, by cut.

    Besides the cuts asked for, the least key of each bin and the key after its
    greatest are told: their bytes are known too, and they close in on a bin
    with few keys at once. within: only rows with this key hash. The driver gets
    a number for each probe, whatever the rows.
    """
    probes = np.array(sorted(set(cuts)), dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        least, most = np.full(len(probes) + 1, HIGH), np.full(len(probes) + 1, LOW)
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(probes, key, side="right")
            np.add.at(total, at, b.column(1).to_numpy(zero_copy_only=False))
            np.minimum.at(least, at, key)
            np.maximum.at(most, at, key)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (np.arange(len(total)), total, least, most)], names=["bin", "bytes", "least", "most"])

    if within is not None:
        rows = rows.where(F.col("h") == within)
    counted = rows.select(F.coalesce(F.col(column), F.lit(LOW)), "size").mapInArrow(count, "bin long, bytes long, least long, most long")
    bins = counted.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("bin").toArrow()
    which, size, low, high = (bins.column(c).to_pylist() for c in ("bin", "bytes", "least", "most"))
    known, under, full = {}, 0, 0
    for i in range(len(probes) + 1):
        if full < len(which) and which[full] == i:
            known[low[full]] = under
            under += size[full]
            if high[full] < HIGH:
                known[high[full] + 1] = under
            full += 1
        if i < len(probes):
            known[int(probes[i])] = under
    return known


def _search(rows: DataFrame, column: str, targets: list[int], tolerance: float, within: int | None = None, base: int = 0) -> list[tuple[int, int, int, int]]:
    """For each target: the cut whose bytes come nearest, these bytes, the greatest known cut at or below the target, and the bytes from there to the next known cut.

    Each round counts up to PROBES cuts in every bracket that is still too wide, all
    in one pass, and narrows the brackets, until the nearest end of each is
    within the tolerance or no key lies inside it. Never more than MAX_PROBES cuts
    are counted at once, however many targets there are; of what is known, only
    the ends of brackets are kept.
    """
    known = {LOW: 0} | _histogram(rows, column, [], within)
    probes = max(1, min(PROBES, MAX_PROBES // max(1, len(targets))))
    while True:
        keys = sorted(known)
        sums = np.array([known[k] for k in keys]) + base
        out, cuts, ends = [], set(), {LOW}
        for t, j in zip(targets, np.searchsorted(sums, np.array(targets), side="right").tolist(), strict=True):
            j = max(0, j - 1)
            lo, hi = keys[j], keys[min(j + 1, len(keys) - 1)]
            ends |= {lo, hi}
            near = lo if abs(known[lo] + base - t) <= abs(known[hi] + base - t) else hi
            out.append((near, known[near] + base, lo, known[hi] - known[lo]))
            if abs(known[near] + base - t) > tolerance and hi - lo > 1 and len(cuts) + probes <= MAX_PROBES:
                cuts |= {lo + (hi - lo) * i // (probes + 1) for i in range(1, probes + 1)}
        cuts -= known.keys()
        if not cuts:
            return out
        known = {k: known[k] for k in ends} | _histogram(rows, column, sorted(cuts), within)


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE, part_bytes: float = 0) -> list[tuple[int, int]]:
    """``parts - 1`` sorted boundaries (h, id): a row belongs right of a boundary if (its h, its id) >= it.

    Rows with the same h are parted, by id, only where all of them have more than ``part_bytes``.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if parts < 2 or not total:
        return [(HIGH, HIGH)] * (parts - 1)
    allowed = tolerance * total / parts
    targets = [total * i // parts for i in range(1, parts)]
    found = _search(rows, "h", targets, allowed)
    out, inside = [(cut, LOW) for cut, _, _, _ in found], defaultdict(list)
    for i, ((_, below, lo, size), t) in enumerate(zip(found, targets, strict=True)):
        if abs(below - t) > max(allowed, 1) and size > part_bytes:
            inside[lo].append(i)
    for lo, at in inside.items():  # these key hashes hold too much: go on inside each, by id
        start = _histogram(rows, "h", [lo])[lo]
        for i, (near, b, _, _) in zip(at, _search(rows, "id", [targets[i] for i in at], allowed, within=lo, base=start), strict=True):
            if abs(b - targets[i]) < abs(found[i][1] - targets[i]):
                out[i] = (lo, near)
    return sorted(out)


def place(cuts: list[tuple[int, int]]) -> Callable[[Column, Column], Column]:
    """A column function of (h, id): how many boundaries lie at or below the key. NULL ids are below all others."""
    heads, tails = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts], dtype=np.int64)

    def run(h: pa.Array, ids: pa.Array) -> pa.Array:
        h, ids = h.to_numpy(zero_copy_only=False), ids.fill_null(LOW).to_numpy(zero_copy_only=False)
        piece = np.searchsorted(heads, h, side="left")
        for v in np.unique(heads[np.isin(heads, h)]):
            at = np.flatnonzero(h == v)
            piece[at] += np.searchsorted(np.sort(tails[heads == v]), ids[at], side="right")
        return pa.array(piece.astype(np.int32))

    return F.arrow_udf(run, "int")


def pieces(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> tuple[list[tuple[int, int]], list[int]]:
    """Boundaries of all pieces, and the shard of each piece (one more than boundaries).

    Boundaries of shards are splitters by bytes; between them lie splitters by
    rows, which may part equal texts, as the pieces of a shard are put together again.
    """
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    by_bytes = splitters(rows, shards, tolerance, PART_SHARE * total / shards)
    parts = min(-(-count * ROW_BYTES // piece_bytes), MAX_PIECES)
    by_rows = splitters(rows.withColumn("size", F.lit(1).cast("long")), parts, 0.1) if parts > 1 else []
    cuts = sorted([(c, 1) for c in by_bytes] + [(c, 0) for c in by_rows])
    return [c for c, _ in cuts], np.cumsum([0] + [new for _, new in cuts]).tolist()


@tidy("shards")
def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Shard and place of every row under the law ``bytes``: shards hold near-equal numbers of bytes.

    Returns id, size, text_crc32, law, shard, slot, grown_shard. ``slot`` counts
    from 0 without gaps in each shard, in the order (hash of text, id). A NULL
    text has size 1 and the CRC of the empty text; NULL ids sort before others.
    A splitter misses its target by at most ``tolerance`` of a shard, by one row
    where rows are larger than that, or by half a class of equal texts where the
    class has up to PART_SHARE of a shard: such a class lies in one shard. Repeated rows each get a slot, and rows
    with equal key stay together, in one task. Fewer rows than shards leave shards empty; an
    empty table gives no rows. No other columns are read.
    """
    rows = settle(sized(docs, id_col, text_col), "sized")
    cuts, shard_of = pieces(rows, shards, tolerance, piece_bytes)
    placed = rows.withColumn("piece", place(cuts)("h", "id")).repartition("piece")
    ranked = settle(placed.withColumn("rank", F.row_number().over(Window.partitionBy("piece").orderBy("h", F.asc_nulls_first("id"), "size")) - 1), "ranked")
    # Rows of a shard's earlier pieces come before: a table of one row for each piece.
    counts = ranked.groupBy("piece").agg(F.count("*").alias("n"))
    known = docs.sparkSession.createDataFrame(list(enumerate(shard_of)), "piece int, shard int")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(known), "piece").select("piece", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranked.join(F.broadcast(offsets), "piece").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
