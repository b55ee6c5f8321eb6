"""The randomised decomposition against numpy's; topics from texts alone."""

import random

import numpy as np
from pyspark.sql import functions as F

from presswork.operators import density, embed

WORDS = {c: [f"{c}{i}" for i in range(40)] for c in ("sport", "music", "money")}


def texts(n, seed=1):
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        topic = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choices(WORDS[topic], k=25) + rng.choices(common, k=10))))
    return out


def test_against_numpy(spark):
    rows = texts(90) + [(1000, None), (1001, ""), (1002, "? a")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    n, dims = 256, 8
    model = embed.fit(df, dims=dims, n=n)
    words = {r["id"]: r["b"] for r in df.select("id", embed.buckets("text", n).alias("b")).collect()}
    a = np.zeros((len(rows), n))
    for i, (k, _) in enumerate(rows):
        for b in words[k]:
            a[i, b] += 1
    seen = (a > 0).sum(axis=0)
    a = np.where(a > 0, 1 + np.log(np.maximum(a, 1)), 0) * np.where(seen > 0, np.log((1 + len(rows)) / (1 + seen)) + 1, 0)
    a /= np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values[:3], s[:3], rtol=1e-4) and np.allclose(model.values, s[:dims], rtol=0.05)  # of near equal ones the last are less exact
    best = np.linalg.norm(a - u[:, :dims] * s[:dims] @ vt[:dims])
    ours = np.linalg.norm(a - a @ model.directions @ model.directions.T)
    assert ours < 1.01 * best
    got = {r["id"]: r["embedding"] for r in model.apply(df).collect()}
    for i, (k, _) in enumerate(rows):
        assert np.allclose(got[k], a[i] @ model.directions)
    assert got[1000] == got[1001] == got[1002] == [0.0] * dims


def test_topics_from_texts(spark):
    df = spark.createDataFrame(texts(240), "id long, text string")
    vectors = embed.fit(df, dims=10).apply(df)
    got = {r["id"]: r["topic_id"] for r in density.discover(vectors, id_col="id").collect()}
    found = {t for t in got.values() if t >= 0}
    assert len(found) == 3
    for c in range(3):
        mine = [got[i] for i in got if i % 3 == c]
        assert max(mine.count(t) for t in found) > 0.7 * len(mine)
        assert len({t for t in mine if t >= 0}) == 1


def test_stop_words_and_case(spark):
    df = spark.createDataFrame([("The the THE Cat",), ("cat",)], "text string")
    a, b = (r["b"] for r in df.select(embed.buckets("text", stop_words=("the",)).alias("b")).collect())
    assert a == b and len(a) == 1
    assert df.select(F.size(embed.buckets("text")).alias("n")).first()["n"] == 4
