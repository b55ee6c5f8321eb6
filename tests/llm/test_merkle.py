"""The manifest against a tree built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from presswork.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return h("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))


def tree(nodes):
    """(root, for every leaf its siblings as (side, digest) or None)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            j = at[i] ^ 1
            p.append((("R" if j > at[i] else "L"), level[j]) if j < len(level) else None)
            at[i] //= 2
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([trees[g][1] for g in order])
    out = []
    for g, outer in zip(order, above):
        own, sub, paths = trees[g]
        for r, p in zip(own, paths):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, int(hit))
            for s in p + outer:
                node = h(node) if s is None else h(s[1] + node if s[0] == "L" else node + s[1])
            out.append((r["doc_id"], leaf(r), sub, root, h("".join(s[1] for s in p + outer if s)), node, node == root))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.manifest(df, claimed=merkle.tampered()).withColumn("proof_sha256", merkle.proof_digest())
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(t):
    return tuple(map(str, t))


@pytest.fixture
def small_blocks(monkeypatch):
    """Superblocks of four nodes; workers get the functions by value, so that they see them too."""
    from pyspark import cloudpickle as own

    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    own.register_pickle_by_value(merkle)
    yield
    own.unregister_pickle_by_value(merkle)


def table(n, seed=1):
    rng = random.Random(seed)
    langs = ["en", "en", "en", "de", None, "", "fr", "é", "zz", "ZZ"]
    rows = [
        {"doc_id": rng.choice([None, i, i, i, rng.randrange(n)]), "text": rng.choice([None, "", "x" * rng.randrange(50), "äöü " * rng.randrange(9)]), "lang": rng.choice(langs), "source": rng.choice([None, "", "a:b", "web"]), "n_chars": rng.choice([None, 0, i, 2**63 - 1])}
        for i in range(n)
    ]
    return rows + rows[:3] + rows[:2]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_small_superblocks(spark, small_blocks, n):
    rows = table(n)
    assert sorted(found(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_one_superblock_and_a_group_beyond(spark):
    rows = table(40, 2) + [{"doc_id": 1000 + i, "text": "t", "lang": "en", "source": "s", "n_chars": i} for i in range(4200)]
    got = found(spark, rows)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {t[-1] for t in got} == {True, False}


def test_proof_leads_to_the_root(spark):
    df = spark.createDataFrame([{"doc_id": i, "text": str(i), "lang": "ab"[i % 2], "source": "s", "n_chars": 1} for i in range(11)], SCHEMA)
    got = merkle.manifest(df).collect()
    assert all(merkle.fold(r["leaf"], r["proof"]) == r["root"] == r["folded_root"] and r["verified"] for r in got)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = table(5)
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("tree", "size", "pos", "node", "row", "position", "group", "leaf", "path", "claim", "small", "at")])
    got = [tuple(r) for r in merkle.manifest(odd).select("doc_id", "leaf", "root").collect()]
    assert sorted(got, key=key) == sorted([(t[0], t[1], t[3]) for t in brute(rows)], key=key)
