"""A stored index of three-byte sequences, so that a substring search reads few blocks of a large table.

Rows lie in blocks of ROWS neighbours, blocks in files and folders by ``part``;
beyond PARTS parts neighbouring ones share a folder, sorted by block.
For every sequence of three bytes of the lower-cased texts the index has the
blocks that hold it, cut into groups of blocks so that no index row grows
without bound. A search intersects the lists of its own sequences, reads those
blocks only, and looks at their texts exactly; queries under three bytes read
the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators.search import contains_ci, numbered
from presswork.session import bound_batches, settle

#: Rows of a block, and blocks of a part (a folder).
ROWS, PART_BLOCKS = 512, 2048
#: Blocks under one index row at most.
GROUP = 32_768
#: Folders that hold the index, by sequence.
FOLDERS = 64
#: Folders that hold the rows at most: beyond that, neighbouring parts share one.
PARTS = 512
#: Pairs of a block and a sequence that a task gathers before it sends them on.
PAIRS = 2 << 20
#: Blocks of a result that are named in the filter of the scan; more are joined.
NAMED = 1000


def _grams(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else np.zeros(0, np.int32)


def grams(raw: bytes) -> np.ndarray:
    """The distinct sequences of three bytes, as numbers below 2**24."""
    return np.unique(_grams(raw))


def _lists(blocks: list[int], met: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(gram, group, blocks) of some blocks' distinct sequences; blocks are counted from the start of their group."""
    own = np.concatenate(met)
    group, at = np.divmod(np.repeat(np.array(blocks, np.int64), [len(m) for m in met]), GROUP)
    order = np.lexsort((at, group, own))
    own, group, at = own[order], group[order], at[order].astype(np.int32)
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    ends = np.append(first, len(own))
    for i in range(0, len(first), 8192):
        cut = ends[i : i + 8193]
        lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(at[cut[0] : cut[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]]), pa.array(group[cut[:-1]]), lists], names=["gram", "group", "blocks"])


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a task's blocks, PAIRS at a time; a block whose rows do not lie side by side, or are cut between tasks, may be told twice."""
    at, raw, size = None, [], 0
    blocks, met, pairs = [], [], 0
    for b in batches:
        for block, texts in zip(b.column("block").to_pylist(), zip(*[c.to_pylist() for c in b.columns[1:]], strict=True), strict=True):
            if block != at:
                if raw:
                    blocks.append(at)
                    met.append(np.unique(np.concatenate(raw)))
                    pairs += len(met[-1])
                at, raw, size = block, [], 0
                if pairs >= PAIRS:
                    yield from _lists(blocks, met)
                    blocks, met, pairs = [], [], 0
            for t in texts:
                if t:
                    raw.append(_grams(t.encode("utf-8", "surrogatepass")))
                    size += len(raw[-1])
            if size > PAIRS:
                raw = [np.unique(np.concatenate(raw))]
                size = 0
    if raw:
        blocks.append(at)
        met.append(np.unique(np.concatenate(raw)))
    if met:
        yield from _lists(blocks, met)


def build(rows: DataFrame, path: str, texts: Sequence[str], key: str, block_rows: int = ROWS, part_blocks: int = PART_BLOCKS) -> None:
    """Write ``rows`` in blocks by the order of ``key`` under path/rows, the index of the text columns under path/grams, and how many parts share a folder under path/layout.

    Rows may repeat; those without key come first. NULL texts hold nothing.
    Column names of the table must not begin with ``block_`` or ``part_``.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    placed = numbered(rows, F.col(key), F.xxhash64(*rows.columns), name="block_place")
    last = placed.agg(F.max("block_place")).first()[0] or 1
    shared = -(-((last - 1) // (block_rows * part_blocks) + 1) // PARTS)
    block = F.floor((F.col("block_place") - 1) / block_rows)
    # Rows lie in order already: each task writes those that it reads.
    laid = placed.select(*rows.columns, block.alias("block_no"), F.floor(block / (part_blocks * shared)).alias("part_no"))
    laid.sortWithinPartitions("part_no", "block_no").write.partitionBy("part_no").parquet(f"{path}/rows")
    spark.range(1).select(F.lit(shared).cast("long").alias("shared")).write.parquet(f"{path}/layout")
    stored = spark.read.schema(laid.schema).parquet(f"{path}/rows")
    parts = stored.select(F.col("block_no").alias("block"), *[F.lower(c).alias(f"t{i}") for i, c in enumerate(texts)]).mapInArrow(_of_blocks, "gram int, group long, blocks array<int>")
    lists = parts.withColumn("folder", F.col("gram") % FOLDERS).repartition("folder").groupBy("folder", "gram", "group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))  # at most GROUP
    lists = lists.withColumn("blocks", F.transform("blocks", lambda b: F.col("group") * GROUP + b))
    lists.sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/grams")


def blocks_of(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """(block): the blocks that hold every sequence of q; None where q is too short to tell."""
    wanted = [int(g) for g in grams(q.lower().encode())]
    if not wanted:
        return None
    lists = spark.read.parquet(f"{path}/grams").where(F.col("folder").isin(sorted({g % FOLDERS for g in wanted})) & F.col("gram").isin(wanted))
    return lists.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("block")


def search(spark: SparkSession, path: str, q: str, texts: Sequence[str], part_blocks: int = PART_BLOCKS, named: int = NAMED) -> DataFrame:
    """The rows with q in one of the text columns, case ignored, as by a scan of the whole table; ``part_blocks`` as it was built."""
    rows = spark.read.parquet(f"{path}/rows")
    found = blocks_of(spark, path, q)
    if found is not None:
        found = settle(found, "blocks")
        few = sorted(r["block"] for r in found.limit(named + 1).collect())
        if len(few) > named:
            rows = rows.join(found, rows["block_no"] == found["block"], "left_semi")
        else:  # folders are pruned by part, row groups by block
            shared = spark.read.schema("shared long").parquet(f"{path}/layout").first()["shared"]
            parts = sorted({b // (part_blocks * shared) for b in few})
            rows = rows.where(F.col("part_no").isin(parts) & F.col("block_no").isin(few)) if few else rows.where("false")
    hit = F.lit(False)
    for c in texts:
        hit = hit | contains_ci(c, q)
    return rows.where(hit).drop("block_no", "part_no")
