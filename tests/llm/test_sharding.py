"""Shards of near-equal bytes, with slots without gaps."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presswork.llm import sharding


def check(rows, shards, got, slack):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((i if i is not None else -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    slots, total = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / shards
    assert all(abs(total[k] - mean) <= slack for k in range(shards))


@pytest.mark.parametrize("piece", [sharding.PIECE_BYTES, 2000])
def test_balanced(spark, piece):
    r = random.Random(1)
    rows = [(i, "é" * r.randint(0, 200)) for i in range(900)] + [(2000 + i, "same text " * 5) for i in range(600)] + [(5000, None), (5001, ""), (None, "no id"), (7, "é"), (7, "é")]
    got = sharding.shard(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, h int"), 8, piece_bytes=piece).collect()
    check(rows, 8, got, 1000)


def test_few_or_no_rows(spark):
    rows = [(1, "a"), (2, "bb" * 5000), (3, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check(rows, 16, got, 20_000)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0


def test_one_class_of_copies_is_split_by_id(spark):
    rows = [(i, "copy") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, 4, got, 15)


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 300}") for i in range(900)]
    of = defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4, tolerance=0.05).collect():
        of[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_very_many_targets_on_few_rows(spark, monkeypatch):
    rows = sharding.sized(spark.createDataFrame([(i, "x" * (50 + i % 7)) for i in range(40)], "doc_id long, text string"), "doc_id", "text")
    rows, asked = rows.cache(), []
    count = sharding._histogram

    def counted(rows, column, cuts, within=None):
        asked.append(len(cuts))
        return count(rows, column, cuts, within)

    monkeypatch.setattr(sharding, "_histogram", counted)
    cuts = sharding.splitters(rows, 100_000)
    assert len(cuts) == 99_999 and cuts == sorted(cuts) and max(asked) <= sharding.MAX_PROBES
    monkeypatch.setattr(sharding, "MAX_PROBES", 8)
    asked.clear()
    few = sharding.splitters(rows, 20, tolerance=0.1)
    assert max(asked) <= 8
    monkeypatch.setattr(sharding, "MAX_PROBES", 1 << 16)
    for got, want in zip(few, sharding.splitters(rows, 20, tolerance=0.1), strict=True):  # the same rows on either side
        below = [rows.where(F.expr(f"h < {h} OR (h = {h} AND id < {i})")).count() for h, i in (got, want)]
        assert below[0] == below[1]


def test_a_class_of_short_texts_is_sorted_in_several_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.repeat(F.col("id").cast("string"), F.lit(200))).alias("text"))
    narrow = sharding.sized(rows, "doc_id", "text")
    cuts, shard_of = sharding.pieces(narrow, 4, piece_bytes=1000 * sharding.ROW_BYTES)
    held = narrow.withColumn("piece", sharding.place(cuts)("h", "id")).groupBy("piece").agg(F.count("*").alias("n"), F.count_if(F.col("size") == 1).alias("empty")).collect()
    assert max(r["n"] for r in held) <= 1300 and sum(r["empty"] > 0 for r in held) >= 8
    assert len({shard_of[r["piece"]] for r in held if r["empty"]}) == 1
    got = sharding.shard(rows, 4, piece_bytes=1000 * sharding.ROW_BYTES).collect()
    check([(i, None if i % 2 == 0 else str(i) * 200) for i in range(20_000)], 4, got, 12_000)
    empty = [r for r in got if r["size"] == 1]
    assert len(empty) == 10_000 and len({r["shard"] for r in empty}) == 1
