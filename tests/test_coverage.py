"""Coverage of runs against counting, and running totals over a whole table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from presswork.operators import monitor, search

DAY = dt.datetime(2026, 1, 1)


def test_coverage_against_counting(spark):
    rng = random.Random(3)
    writes = [(rng.randrange(40), DAY + dt.timedelta(minutes=rng.choice([0, 5, 5, rng.randrange(4000)]))) for _ in range(200)] + [(1, None)]
    runs = [(i, a := DAY + dt.timedelta(minutes=rng.choice([0, 5, rng.randrange(4000)])), a + dt.timedelta(minutes=rng.randrange(-50, 900))) for i in range(30)]
    runs += [(100, DAY, DAY + dt.timedelta(days=3650)), (101, DAY + dt.timedelta(minutes=5), DAY + dt.timedelta(minutes=5)), (102, DAY - dt.timedelta(days=2), DAY - dt.timedelta(days=1))]
    labelled = [(i,) for i in range(0, 40, 3)] * 2
    got = monitor.coverage(
        spark.createDataFrame(runs, "run_id long, started_at timestamp, finished_at timestamp"), spark.createDataFrame(writes, "article_id long, written_at timestamp").repartition(4), spark.createDataFrame(labelled, "article_id long")
    )
    want = {}
    for i, a, b in runs:
        inside = [x for x, t in writes if t is not None and a <= t <= b]
        if inside:
            want[i] = (len(inside), sum(x % 3 == 0 for x in inside))
    assert {r["run_id"]: (r["written"], r["covered"]) for r in got.collect()} == want


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit(2).alias("n"))
    got = search.running_totals(df, [F.col("id")], {"n": "total"}).collect()
    assert sorted((r["id"], r["total"]) for r in got) == [(i, 2 * (i + 1)) for i in range(1000)]
