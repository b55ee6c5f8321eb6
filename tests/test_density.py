"""Density topics on planted clusters; neighbours and forests against brute force."""

import numpy as np
import pytest

from presswork.operators import density

SCHEMA = "vec_id long, embedding array<double>"


def planted(sizes, widths, noise, dims=50, seed=3):
    rng = np.random.default_rng(seed)
    out, truth = [], []
    for c, (n, w) in enumerate(zip(sizes, widths)):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        out.append(centre + rng.standard_normal((n, dims)) * w / np.sqrt(dims))
        truth += [c] * n
    out.append(rng.standard_normal((noise, dims)))
    return np.concatenate(out), truth + [-1] * noise


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA).repartition(4)


def test_neighbours_are_exact_in_one_window_and_near_in_several(spark, monkeypatch):
    x, _ = planted([150, 150], [0.3, 0.5], 60)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    far = 1 - u @ u.T
    np.fill_diagonal(far, np.inf)
    nodes = density.unit_nodes(frame(spark, x), "embedding")
    index = {tuple(r["raw"]): r["node"] for r in nodes.select("raw", "node").collect()}
    at = [index[tuple(v)] for v in x.tolist()]
    back = {n: i for i, n in enumerate(at)}
    want = {i: set(np.argsort(far[i])[:5]) for i in range(len(x))}

    def recall():
        got = {back[r["node"]]: {back[s["to"]] for s in r["near"]} for r in density.neighbours(nodes, 5).collect()}
        return np.mean([len(got[i] & want[i]) / 5 for i in want])

    assert recall() == 1
    monkeypatch.setattr(density, "WINDOW", 90)
    assert recall() > 0.9


def test_spanning_forest(spark):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)): round(float(rng.random()), 1) for a, b in rng.integers(0, 60, (200, 2)) if a < b}
    pairs |= {(100, 101): 0.0, (101, 102): 2.0, (100, 102): 2.0}
    got = {(r["a"], r["b"], r["w"]) for r in density.spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double")).collect()}
    parent, want = {}, set()

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for (a, b), w in sorted(pairs.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b, w))
    assert got == want


def test_planted_clusters_of_unequal_density(spark):
    sizes, widths = [200, 120, 80, 60, 40], [0.2, 0.35, 0.5, 0.25, 0.6]
    x, truth = planted(sizes, widths, 60)
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)])  # copies of one row
    truth += [0] * 30
    df = frame(spark, x).union(spark.createDataFrame([(9000, None), (9001, [float("nan")] * 50), (9002, [])], SCHEMA))
    got = {r["vec_id"]: r["topic_id"] for r in density.discover(df).collect()}
    assert len(got) == len(x) + 3 and got[9000] == got[9001] == got[9002] == -1
    topics = {t for t in got.values() if t >= 0}
    assert topics == set(range(5))
    for c in range(5):
        mine = [got[i] for i in range(len(x)) if truth[i] == c]
        most = max(topics, key=mine.count)
        assert mine.count(most) >= 0.75 * len(mine)  # the fringe of a thin one is left out
        assert sum(v == most for v in got.values()) < 1.1 * len(mine)
    assert sum(got[i] == -1 for i in range(len(x)) if truth[i] == -1) > 50
    sizes = [list(got.values()).count(t) for t in range(5)]
    assert sizes == sorted(sizes, reverse=True)


def test_few_rows_are_refused_and_copies_alone_are_a_topic(spark):
    with pytest.raises(ValueError, match="at least 10"):
        density.discover(frame(spark, np.eye(9)))
    assert [r["topic_id"] for r in density.discover(frame(spark, np.repeat(np.eye(30)[:1], 25, axis=0))).collect()] == [0] * 25
    assert [r["topic_id"] for r in density.discover(frame(spark, np.repeat(np.eye(30)[:1], 25, axis=0)), min_size=26).collect()] == [-1] * 25


def test_components_of_levels_are_those_of_the_forest(spark):
    rng = np.random.default_rng(9)
    pairs = {(int(min(a, b)), int(max(a, b))): round(float(rng.random()), 2) for a, b in rng.integers(0, 150, (400, 2)) if a != b}
    forest, up = density._grown(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double"))
    nodes = spark.createDataFrame([(i, 1) for i in range(150)], "node long, weight long")
    levels = [0.02, 0.1, 0.1001, 0.3, 0.5, 0.99]
    got = {(r["level"], r["node"]): r["c"] for r in density._members(up, nodes, levels).collect()}
    want, links = {}, [tuple(r) for r in forest.collect()]
    for i, e in enumerate(levels):
        own = {x: x for a, b, w in links if w <= e for x in (a, b)}
        for _ in own:
            for a, b, w in links:
                if w <= e:
                    own[a] = own[b] = min(own[a], own[b])
        want |= {(i, x): c for x, c in own.items()}
    assert got == want


def test_nearest_by_partition_are_those_of_a_stable_sort():
    far = np.random.default_rng(2).integers(0, 9, (60, 40)).astype(float)
    far[0] = 1.0
    for n in (0, 1, 5, 39, 40):
        assert (density._least(far, n) == np.argsort(far, axis=1, kind="stable")[:, :n]).all()


def test_discovery_has_no_rounds_over_all_levels(spark):
    from unittest import mock

    from presswork.operators import components

    with mock.patch.object(components, "components", side_effect=AssertionError):
        x, _ = planted([60, 60], [0.2, 0.3], 10)
        assert "components" not in vars(density) and density.discover(frame(spark, x)).count() == 130
