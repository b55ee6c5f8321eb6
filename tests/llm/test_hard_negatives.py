"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row int, anchor string, score double"


def brute(rows, k=5, m=10):
    """Every row is its own, also if repeated; rows of other lengths are not compared."""
    ok = [
        (i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) * 256 < 2**31 for x in v)
    ]
    out = []
    for n, (i, lab, v) in enumerate(ok):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, c == lab) for o, (j, c, w) in enumerate(ok) if o != n and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            window = [(s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:m]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, lab, 1, "x", 0.5) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())


def random_rows(n, seed, coarse):
    rng = random.Random(seed)
    value = lambda: rng.choice([-0.5, 0.0, 0.25, 0.5]) if coarse else rng.gauss(0.1, 0.4)
    rows = [(rng.choice([i * 25, i]), [value() for _ in range(6)], rng.randrange(3)) for i in range(n)]
    return rows + rng.choices(rows, k=n // 5)


@pytest.fixture
def small(monkeypatch):
    from pyspark import cloudpickle as own

    for name, v in {"CHUNK": 16, "ANCHORS": 3, "FIRST": 2}.items():
        monkeypatch.setattr(hn, name, v)
    own.register_pickle_by_value(hn)
    yield
    own.unregister_pickle_by_value(hn)


@pytest.mark.parametrize("coarse", [True, False])
def test_ties_repeats_and_many_chunks(spark, small, coarse):
    rows = random_rows(40, 3, coarse)
    assert found(spark, rows) == brute(rows) != []


def test_rows_that_take_no_part(spark):
    rows = random_rows(30, 5, True) + [
        (None, [1.0] * 6, 1), (100, None, 1), (200, [1.0] * 6, None), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (400, [float("nan")] * 6, 0), (500, [float("inf")] * 6, 0),
        (600, [1e300] * 6, 0), (700, [1.0], 0), (701, [2.0], 0), (702, [0.5], 1), (800, [], 0), (801, [], 0), (802, [], 1), (900, [4e6] * 6, 2), (901, [4e6] * 6, 2), (902, [2e6] * 6, 1),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {700, 800, 900} <= {r[0] for r in got}
    assert found(spark, []) == [] == found(spark, [(7, [1.0], 1)])


def test_reading_stops_when_the_threshold_is_below_every_window():
    rng = np.random.default_rng(1)
    vectors = np.round(rng.pareto(1.5, (4000, 4)) * 20).astype(np.int64)
    lists = hn.Lists(vectors, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64))
    anchor = np.array([3, 1, 0, -2])
    scores = vectors @ anchor
    windows = [(hn.LEAST, hn.MOST), (0, int(np.sort(scores)[-50]))]
    f = hn.Found(windows, 5)
    assert lists.search(anchor, f, None) < 2000
    for (low, high), (s, i, _) in zip(windows, f.best):
        at = [j for j in np.lexsort((np.arange(4000), -scores)) if low <= scores[j] <= high][:5]
        assert i.tolist() == at and s.tolist() == scores[at].tolist()


def test_equal_scores_at_the_threshold_are_met(monkeypatch):
    """A tie with the k-th score may have a smaller id, so the threshold must be strictly below."""
    monkeypatch.setattr(hn, "FIRST", 1)
    vectors = np.full((50, 2), 7)
    lists = hn.Lists(vectors, np.arange(50)[::-1].copy(), np.arange(50), np.zeros(50, np.int64))
    f = hn.Found([(hn.LEAST, hn.MOST)], 3)
    lists.search(np.array([1, -1]), f, None)
    assert f.best[0][1].tolist() == [0, 1, 2]
