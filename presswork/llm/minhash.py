"""Near duplicates: circulant MinHash, banding, and exact Jaccard on full sets.

Two permutations make the whole signature: the first scatters the shingles of a
document over 2**32 places, the second, circularly shifted by k, gives the
order whose minimum is coordinate k. Texts with the same set of shingles are one
class, so copies cost a row each and no pairs. Every bucket links its members to
its first member. In buckets that this leaves in several components only pairs of
different components are looked at, and of these only pairs that an exact bound
lets through are verified. Where pairs to look at are many, a few further pivots
from each bucket's largest component first take in what is near to them, as long
as that halves what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.components import components
from presswork.llm.wordhash import U, chunks, mix, shingles, word_hashes
from presswork.session import bound_batches, settle, tidy

#: 32 bands of 4: a pair at Jaccard 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
#: Bits of the odd sketch: bit i tells whether a set has an odd number of shingles in place i. Sets of twice as many
#: shingles and more have a wide sketch besides, of a bit for one or two shingles, so that the bound it gives stays sharp.
ODD_BITS = 1024
#: About so many further pivots a bucket are tried if more than so many pairs a row are left to look at, and again until one a row is left, at most so often.
PIVOTS, PAIRS_A_ROW, ROUNDS = 6, 128, 8
#: At most so many ids are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_SIGMA = U(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; none for a text without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    with np.errstate(over="ignore"):
        for start, end in chunks(raw):
            hashes, first = word_hashes(raw[start:end])
            for i in range(end - start):
                yield np.unique(shingles(hashes[first[i] : first[i + 1]], n))


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (one row per set, one column per band) of non-empty sets."""
    out = np.empty((len(sets), bands), dtype=U)
    if not sets:
        return out
    at = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    with np.errstate(over="ignore"):
        places = (mix(np.concatenate(sets) ^ _SIGMA) >> U(32)).astype(np.uint32)
        for band in range(bands):
            key = np.full(len(sets), band + 1, dtype=U)
            for k in range(band * rows, band * rows + rows):
                x = places + np.uint32(k)  # the shift, modulo 2**32
                x ^= x >> np.uint32(16)
                x *= np.uint32(0x85EBCA6B)
                x ^= x >> np.uint32(13)
                x *= np.uint32(0xC2B2AE35)
                x ^= x >> np.uint32(16)
                key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at))
            out[:, band] = key
    return out


def odd_sketch(s: np.ndarray, bits: int = ODD_BITS) -> bytes:
    """The parity of the number of shingles in each of ``bits`` places (a power of two)."""
    places = np.bincount((s >> U(40)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((places & 1).astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> np.ndarray | None:
    """An odd sketch of the largest power of two up to the set's size, as 64-bit integers; None for sets that ODD_BITS suit."""
    return np.frombuffer(odd_sketch(s, 1 << (len(s).bit_length() - 1)), dtype=np.int64) if len(s) >= 2 * ODD_BITS else None


def _apart(x: str, y: str) -> Column:
    """In how many places two odd sketches differ."""
    return reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(ODD_BITS // 64)])


def _wide_apart(x: str, y: str) -> Column:
    """The same for wide sketches: of one twice as wide as the other, the halves are laid on each other first."""
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(c: str, to: Column) -> Column:
        return F.when(F.size(c) > to, F.zip_with(F.slice(c, F.lit(1), to), F.slice(c, to + 1, to), xor)).otherwise(F.col(c))

    least = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, least), folded(y, least), xor), F.lit(0), lambda n, w: n + F.bit_count(w))


def _sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, number of shingles, digest of the set (NULL for empty sets), band keys, odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = list(shingle_sets(b.column(1).slice(start, 512).to_pylist(), n))
                full = [s for s in part if len(s)]
                keys = iter(signatures(full, bands, rows).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(part)),
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in part], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in part], pa.list_(pa.int64())),
                        pa.array([np.frombuffer(odd_sketch(s), dtype=np.int64) for s in part], pa.list_(pa.int64())),
                        pa.array([wide_sketch(s) for s in part], pa.list_(pa.int64())),
                    ],
                    names=["id", "size", "digest", "keys", "odd", "wide"],
                )

    return docs.mapInArrow(run, "id long, size long, digest binary, keys array<long>, odd array<long>, wide array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have Jaccard >= percent / 100."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = settle(ids, "ids")
    wanted = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    wanted = settle(wanted, "texts")
    joined = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                both = list(shingle_sets(b.column("ta").to_pylist() + b.column("tb").to_pylist(), n))
                good = []
                for x, y in zip(both[: b.num_rows], both[b.num_rows :], strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield b.select(["a", "b"]).filter(pa.array(good))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(sketches with the class representative ``rep``, verified links (a, b) between representatives).

    The links need not be all pairs over the threshold: a pair inside one
    component may be missing, a pair that joins two components may not.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    sketched = settle(_sketch(docs, n, bands, rows), "sketch")
    whole = sketched.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = settle(whole.groupBy("digest").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("size", "keys", "odd", "wide")]), "classes")
    buckets = settle(classes.select(F.col("rep").alias("id"), "size", F.posexplode("keys").alias("band", "key")), "buckets")
    heads = settle(buckets.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).where("members > 1"), "heads")
    members = buckets.join(heads, ["band", "key"])
    near = (F.col("size") * 100 >= F.col("other") * percent) & (F.col("other") * 100 >= F.col("size") * percent)
    checked = settle(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    linked = settle(_verified(checked, docs, n, percent), "linked")
    # An id with several texts is one document: the classes of its texts are linked.
    several = settle(whole.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id"), "several")
    if several.limit(1).count():
        same = whole.join(several, "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        linked = linked.union(settle(same.where("a <> b").distinct(), "linked"))

    # Odd sketches differ in no more places than the sets differ in shingles: an exact bound, and no set need be read.
    room = (F.col("size") + F.col("other")) * (100 - percent)
    close = near & (_apart("oa", "ob") * (100 + percent) <= room) & F.when(F.col("wa").isNull() | F.col("wb").isNull(), True).otherwise(_wide_apart("wa", "wb") * (100 + percent) <= room)
    large = settle(members.where("members > 2").select("band", "key", "id", "size"), "large")
    before = None
    for turn in range(ROUNDS + 1):
        # Buckets of three or more that the links so far leave in several components.
        known = components(linked).select(F.col("node").alias("id"), "component")
        labelled = settle(large.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
        counts = labelled.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
        split = counts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("n").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("inside"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("largest")).where("parts > 1")
        split = settle(split, "split")
        left, inside = split.agg(F.coalesce(F.sum(F.col("m").cast("double") * F.col("m") - F.col("inside")), F.lit(0.0)) / 2, F.coalesce(F.sum("m"), F.lit(0))).first()
        if not left:
            break
        again = labelled.join(split.select("band", "key", "main", "largest"), ["band", "key"]).join(classes.select(F.col("rep").alias("id"), "odd", "wide"), "id")
        again = settle(again.select("band", "key", "id", "size", "component", "odd", "wide", "main", "largest"), "again")
        x = again.select("band", "key", F.col("id").alias("a"), "size", F.col("component").alias("ca"), F.col("odd").alias("oa"), F.col("wide").alias("wa"), "main", "largest")
        y = again.select("band", "key", F.col("id").alias("b"), F.col("size").alias("other"), F.col("component").alias("cb"), F.col("odd").alias("ob"), F.col("wide").alias("wb"), "main", "largest")
        last = turn == ROUNDS or left <= (PAIRS_A_ROW * inside if turn == 0 else inside) or before is not None and left > before / 2
        before = left
        if last:
            pairs = x.drop("main", "largest").join(y.drop("main", "largest"), ["band", "key"]).where("a < b AND ca <> cb").where(close).select("a", "b").distinct()
        else:  # some of the largest component against what lies outside it; of each row the nearest, chosen where pairs are made
            pivot = F.pmod(F.xxhash64("a", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("largest") / PIVOTS))) == 0
            near_pivots = x.where((F.col("ca") == F.col("main")) & pivot).join(y.where(F.col("cb") != F.col("main")).drop("main", "largest"), ["band", "key"]).where(close)
            pairs = near_pivots.groupBy("b").agg(F.min_by("a", F.struct(_apart("oa", "ob"), "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = settle(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            linked, checked = linked.union(settle(_verified(pairs, docs, n, percent), "linked")), checked.union(pairs)
        if last:
            break
    return _classed(sketched, classes), linked


def _classed(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """The sketches with the representative of their class."""
    return sketched.select("id", "size", "digest").join(classes.select(F.col("digest").alias("of"), "rep"), F.col("digest") == F.col("of"), "left").drop("of")


@tidy("near")
def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """Component of near duplicates of every document: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer than
    n words has its whole word sequence as its one shingle; NULL texts and texts
    without words have none, are linked with nothing and stay. Documents are
    linked when 100 * |A and B| >= percent * |A or B| on the full sets;
    ``component_id`` is the smallest id reachable over links, and the document
    with that id is kept. Rows with the same id are one document, linked by each
    of its texts; every row is returned, as often as it occurs. Whole texts are
    read, however long; an empty table gives no rows. A row without id is linked
    with nothing and kept (its ``component_id`` is NULL). Only the two named
    columns are read.
    """
    sketched, linked = links(docs, n, percent, id_col, text_col, **how)
    found = components(linked).select(F.col("node").alias("rep"), F.col("component"))
    out = sketched.join(found, "rep", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
