"""Assignment to topics: pruning by pivots gives the rows of a full comparison."""

import numpy as np
import pytest

from presswork.operators import topics


def families(topics_in_each, seed, size=48):
    """Unit topics in 20 tight families, and vectors near them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    model = np.repeat(centres, topics_in_each, axis=0) + 0.15 * rng.normal(size=(20 * topics_in_each, size))
    rows = model[rng.integers(len(model), size=600)] + 0.15 * rng.normal(size=(600, size))
    return model, rows


def brute(model, rows, threshold):
    a = model / np.linalg.norm(model, axis=1, keepdims=True)
    b = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    s = np.floor(b @ a.T * 1e6 + 0.5) / 1e6
    j = s.argmax(axis=1)
    best = s[np.arange(len(rows)), j]
    return {i: (int(j[i]) if best[i] >= threshold else -1, round(float(best[i]), 6)) for i in range(len(rows))}


@pytest.mark.parametrize("block", [topics.MODEL_BLOCK, 70])
def test_pruned_rows_are_those_of_a_full_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(topics, "MODEL_BLOCK", block)
    model, rows = families(20, 1)
    model[7] = model[3] * 2  # the same direction: the lower id is nearer
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(model)], "topic_id int, centroid array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = topics.assign(v, m, 0.9, counted=True).collect()
    assert {r["vec_id"]: (r["topic_id"], round(r["similarity"], 6)) for r in got} == brute(model, rows, 0.9)
    if block == topics.MODEL_BLOCK and block > 400:
        assert np.mean([r["compared"] for r in got]) < 0.25 * len(model)


def test_random_points_without_structure(spark):
    rng = np.random.default_rng(2)
    model, rows = rng.normal(size=(90, 5)), rng.normal(size=(300, 5))
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(model)], "topic_id int, centroid array<double>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["topic_id"], round(r["similarity"], 6)) for r in topics.assign(v, m, -1.0).collect()} == brute(model, rows, -1.0)


def test_vectors_without_a_direction(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [*enumerate(bad), (100, [1.0, 0.1]), (100, [1.0, 0.1]), (None, [0.1, 1.0])]
    v = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "vec_id long, embedding array<double>, topic_id string, compared int")
    m = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [2.0, 0.0]), (4, [0.0, 2.0]), (5, [0.0, 3.0])], "topic_id int, centroid array<double>")
    got = topics.assign(v, m).collect()
    assert sorted(r["vec_id"] if r["vec_id"] is not None else -1 for r in got) == [-1, *range(len(bad)), 100, 100]
    for r in got:
        want = {100: 3, None: 4}.get(r["vec_id"], -1)
        assert r["topic_id"] == want and (r["similarity"] is None) == (want == -1)
    none = topics.assign(v, m.where("false")).collect()
    assert len(none) == len(got) and all(r["topic_id"] == -1 and r["similarity"] is None for r in none)
    assert topics.assign(v.where("false"), m).count() == 0
