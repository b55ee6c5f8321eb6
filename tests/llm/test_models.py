"""Toxicity and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from presswork.llm import ppm, toxicity


def labelled(spark, n=1500):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        bad = r.random() < 0.2
        text = [r.choice(words) for _ in range(30)] + (["nasty", "slur"] if bad else [])
        r.shuffle(text)
        docs.append((i, " ".join(text), int(bad)))
    return docs


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    # labels of held-out rows do not matter
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()} == {r["doc_id"]: r["score"] for r in got}
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "y " * 50000), (4, "z")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 5
    some = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (4, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, some).count() == 5
    assert toxicity.toxicity(docs.where("false"), some).count() == 0


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]


def brute(rows, held):
    counts, words, n_docs = defaultdict(Counter), Counter(), 0
    k, end = ppm.ORDER, bytes([ppm.END])
    coded = {i: end * k + " ".join(tokens(t)).encode() + end for i, t in rows}
    for i, t in rows:
        if not held[i]:
            words.update(tokens(t))
            n_docs += 1
            for p in range(k, len(coded[i])):
                for c in range(k + 1):
                    counts[coded[i][p - c : p]][coded[i][p]] += 1
    n, v = sum(words.values()) + n_docs, len(words) + (1 if n_docs else 0)
    out = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((n_docs + 1) / (n + v + 1))
        score = 0.0
        for p in range(k, len(coded[i])):
            out_of = set()
            for c in range(k, -1, -1):
                left = {s: m for s, m in counts.get(coded[i][p - c : p], {}).items() if s not in out_of}
                if not left:
                    continue
                total = sum(left.values())
                if coded[i][p] in left:
                    score += math.log10((left[coded[i][p]] - 0.5) / total)
                    break
                score += math.log10(0.5 * len(left) / total)
                out_of |= set(left)
            else:
                score -= math.log10(max(1, 256 - len(out_of)))
        out[i] = (len(w) + 1, sum(words[x] > 0 for x in w) + (1 if n_docs else 0), n, base, score)
    return out


def test_ppm_against_brute_force(spark):
    r = random.Random(4)
    parts = ["the ", "Thing", "ing ", "é", "\n", "  ", "stone", "x", "日", "."]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (102, " \t "), (103, "new zq")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    for size in (ppm.BLOCK_BYTES, 500):
        got = {x["doc_id"]: x for x in ppm.ppm_scores(df, ppm.held_out_fold(), block_bytes=size).collect()}
        for i, (n, known, train, base, score) in brute(rows, held).items():
            g = got[i]
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], n, known, train)
            assert math.isclose(g["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g["score"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_ppm_edges(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "x y")], "doc_id long, text string")
    assert ppm.ppm_scores(df, ppm.held_out_fold()).count() == 3
    untrained = ppm.ppm_scores(df, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in untrained)
    assert math.isclose(untrained[0]["score"] if untrained[0]["doc_id"] == 1 else untrained[1]["score"], -4 * math.log10(256))
    assert ppm.ppm_scores(df.where("false"), ppm.held_out_fold()).count() == 0


def test_ftrl_against_a_plain_one():
    """The vectorised learner gives the weights of one that goes through the coordinates one by one."""
    r = random.Random(7)
    texts = [" ".join(r.choice(["good", "bad", "vile", "kind", "the", "a", "day"]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    rows = [(f, int("vile" in t or "bad bad" in t)) for f, t in zip(toxicity.features(texts), texts, strict=True)]
    at, weights = toxicity.ftrl(rows)
    z, n = defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        if i != bias and abs(z[i]) <= toxicity.L1:
            return 0.0
        if i == bias:
            return -z[i] / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for f, label in rows:
            own = [*f.tolist(), bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in list(z) if weight(i)}
    got = dict(zip(at.tolist(), weights.tolist(), strict=True))
    assert got.keys() == want.keys() and len(got) > 3
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_ppm_slabs(spark, monkeypatch):
    """With slabs of two blocks the sums go through several levels, and nothing changes."""
    r = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(r.choice(["aa", "ab", "ba", "c"]) for _ in range(r.randint(0, 40)))) for i in range(80)], "doc_id long, text string")
    key = lambda x: (x["doc_id"], x["n_known"], x["train_tokens"], round(x["base_score"], 9), round(x["score"], 9))
    whole = sorted(key(x) for x in ppm.ppm_scores(df, ppm.held_out_fold()).collect())
    monkeypatch.setattr(ppm, "SLAB", 2)
    assert sorted(key(x) for x in ppm.ppm_scores(df, ppm.held_out_fold(), block_bytes=1000).collect()) == whole
