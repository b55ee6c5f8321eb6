"""Exact and near duplicates against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from presswork.llm import components, exact_dedup, minhash


def brute_exact(rows):
    out = []
    for i, t in rows:
        same = [j for j, x in rows if (x or "") == (t or "")]
        known = [j for j in same if j is not None]
        keep = max(known) if known else None
        out.append((i, t or "", keep, len(same), i == keep))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b" * 300 + "x"), (6, "b" * 300 + "y"), (7, "b" * 300 + "x"), (8, "A"), (2, "a"), (None, "a"), (None, "a"), (None, None), (9, "long " * 30000), (10, "long " * 30000), (None, "only")]


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_PAIRS, 0])
def test_exact(spark, limit):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, keep_id string, full int")
    df = df.withColumn("t", F.coalesce("text", F.lit("")))
    got = exact_dedup.exact_dedup(df, carry=("t",), broadcast_pairs=limit).collect()
    assert sorted(((r["doc_id"], r["t"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == brute_exact(ROWS)  # a row for every row


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w).title()))
            i += 1
    same = "one two three four five six seven eight nine ten"
    rows += [(i + k, same if k % 2 else same.upper()) for k in range(40)]
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "two words"), (904, "Two  WORDS"), (905, "two"), (906, "x " * 40000), (907, "x " * 39000)]


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 80), (2, 50)])
def test_near(spark, n, percent):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, size int, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, n, percent, bands=64 if percent < 80 else 32, rows=2 if percent < 80 else 4).collect()}
    assert got == brute_near(rows, n, percent)


def test_near_ties_and_nulls(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (3, text), (7, None)], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 5
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (8, a), (9, c)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 3, False), (3, 3, True), (8, 3, False), (9, 9, True)}


@pytest.mark.parametrize("pairs_a_row", [minhash.PAIRS_A_ROW, 0])
def test_large_buckets_of_several_families(spark, monkeypatch, pairs_a_row):
    """Families that share half of their text meet in large buckets; further pivots or pairs must part them, and find all links."""
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", pairs_a_row)
    r = random.Random(11)
    shared, rows = [f"t{i}" for i in range(150)], []
    for family in range(4):
        base = shared + [f"f{family}x{i}" for i in range(60 + 30 * family)]
        for _ in range(60):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"r{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows, 5, 80)


def test_wide_sketches(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows, want = [], []
    for _ in range(30):
        x = np.unique(r.integers(0, 1 << 63, r.integers(2100, 9000)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * r.uniform(0.4, 1))], r.integers(0, 1 << 63, len(x) // 6).astype(np.uint64)]))
        if len(y) >= 2 * minhash.ODD_BITS and max(len(x), len(y)) * 0.8 <= min(len(x), len(y)):
            rows.append((minhash.wide_sketch(x).tolist(), minhash.wide_sketch(y).tolist()))
            want.append(len(np.setxor1d(x, y)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, wa array<long>, wb array<long>")
    got = {x["i"]: x["d"] for x in df.select("i", minhash._wide_apart("wa", "wb").alias("d")).collect()}
    assert len(rows) > 5 and all(0 < got[i] <= n for i, n in enumerate(want))


def test_odd_sketch_is_a_lower_bound():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[: r.integers(0, 300)], r.integers(0, 1 << 63, 30).astype(np.uint64)]))
        bits = sum(bin(a ^ b).count("1") for a, b in zip(minhash.odd_sketch(x), minhash.odd_sketch(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(5, 5), (None, 3)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
