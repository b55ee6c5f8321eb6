"""Writes by key: repeated, interrupted, and only where keys fall; joins over buckets without a shuffle."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from presswork.operators import merge
from presswork.sources import keyed

SCHEMA = "id long, method string, n long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shown(t):
    return sorted((tuple(r) for r in t.read().select("id", "method", "n").collect()), key=str)


def test_upserts_and_appends_against_a_dict(spark, tmp_path):
    rng = random.Random(1)
    t, want = keyed.KeyedTable(spark, str(tmp_path / "t"), ["id", "method"], parts=5), {}
    for step in range(4):
        data = [(rng.choice([None, *range(12)]), rng.choice(["a", None]), step * 100 + i) for i in range(15)]
        for again in range(2):  # a repeated write changes nothing
            if step % 2:
                t.append_missing(rows(spark, data), "n")
                for i, m, n in data if not again else ():
                    want.setdefault((i, m), n)
            else:
                t.upsert(rows(spark, data), "n")
                want.update({(i, m): n for i, m, n in data})
            assert shown(t) == sorted(((i, m, n) for (i, m), n in want.items()), key=str)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), ["id"], parts=16)
    t.upsert(rows(spark, [(i, "a", i) for i in range(200)]), "n")
    files = lambda: {(p.name, p.parent.name) for p in (tmp_path / "t").glob("part=*/*.parquet")}
    before = files()
    t.upsert(rows(spark, [(7, "b", 1000)]), "n")
    after = files()
    assert len({d for _, d in before - after}) == len({d for _, d in after - before}) == 1
    t.append_missing(rows(spark, [(7, "c", 2000)]), "n")
    assert files() == after


def test_a_write_that_ended_half_way_is_finished_or_forgotten(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), ["id", "method"], parts=4)
    t.upsert(rows(spark, [(1, "a", 1), (2, "a", 1)]), "n")
    finish = keyed.KeyedTable._finish
    monkeypatch.setattr(keyed.KeyedTable, "_finish", lambda self: None)
    t.upsert(rows(spark, [(1, "a", 2), (3, "a", 2)]), "n")  # lost after the rows are written beside the table
    monkeypatch.setattr(keyed.KeyedTable, "_finish", finish)
    assert shown(t) == [(1, "a", 2), (2, "a", 1), (3, "a", 2)]
    (tmp_path / "t.pending").mkdir()  # lost before that
    (tmp_path / "t.pending" / "part-0.parquet").write_bytes(b"half")
    assert shown(t) == [(1, "a", 2), (2, "a", 1), (3, "a", 2)]
    t.upsert(rows(spark, [(4, "a", 3)]), "n")
    assert len(shown(t)) == 4


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_merged_corpus_over_buckets_needs_no_shuffle(spark, no_broadcast):
    n, tag = 50, uuid.uuid4().hex[:8]
    ids = spark.range(n)
    articles = ids.select("id", F.lit("t").alias("title"), F.lit("s").alias("source"), F.lit("u").alias("url"), F.lit("d").alias("published_date"), F.lit("c").alias("clean_content"), F.lit(True).alias("llm_relevant"), F.lit("success").alias("processing_status"))
    label = ids.select((F.col("id") * 7 % 90).alias("article_id"), "id")
    parts = [
        label.withColumns({"classifier": F.lit("x"), "classified_at": F.lit("1"), "source_type": F.lit("n"), "stakeholder_category": F.lit("p")}), label.withColumns({"stable_topic_id": F.lit("1"), "topic": F.lit("t")}),
        label.withColumns({"method": F.lit("m"), "sentiment": F.lit("positive")}), label.withColumn("stance", F.lit("favor")), label.withColumns({"method": F.lit(merge.COMMENT_METHOD), "sentiment": F.lit("neutral")}),
    ]
    names = [f"bucketed_{tag}_{i}" for i in range(6)]
    try:
        stored = [keyed.store_bucketed(articles, names[0], "id", 8), *[keyed.store_bucketed(p, x, "article_id", 8) for p, x in zip(parts, names[1:])]]
        over = merge.merged_corpus(*stored)
        got = over.collect()
        assert not re.search(r"Exchange", over._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(str, got)) == sorted(map(str, merge.merged_corpus(articles, *parts).collect()))
    finally:
        for x in names:
            spark.sql(f"DROP TABLE IF EXISTS {x}")
