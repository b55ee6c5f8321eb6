"""The automaton against plain counting; dictionaries of any size, in blocks."""

import random

from pyspark.sql import functions as F

from presswork.functions import classify
from presswork.operators import terms


def plain(text, rows):
    out = {}
    for place, t in rows:
        if t and text and text.count(t):
            out[place] = out.get(place, 0) + text.count(t)
    return out


def test_matcher_against_plain_counting():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.randrange(3), "".join(rng.choices("ab", k=rng.randrange(5)))) for _ in range(6)]
        text = "".join(rng.choices("abc", k=60))
        assert dict(terms.Matcher(rows).counts(text)) == plain(text, rows)
    assert not terms.Matcher([]).counts("abc") and not terms.Matcher([(0, "a")]).counts(None)


def test_blocks_give_the_same_and_nulls_count_nothing(spark):
    rng = random.Random(4)
    groups = {g: tuple("".join(rng.choices("abcd", k=3)) for _ in range(30)) for g in ("x", "y", "z")}
    rows = [(i, "".join(rng.choices("abcde ", k=80))) for i in range(40)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    d = terms.dictionary(spark, groups).union(spark.createDataFrame([("x", 0, None), ("x", 0, "")], "name string, place int, term string"))
    flat = [(i, t) for i, g in enumerate(groups.values()) for t in g]
    for size in (1 << 20, 200):
        got = {r["id"]: r for r in terms.count_terms(df, d, F.col("t"), block_bytes=size).collect()}
        for i, t in rows:
            summed = {}
            for h in got[i]["hits"]:
                summed[h["place"]] = summed.get(h["place"], 0) + h["n"]
            assert summed == plain(t, flat)


def test_best_group_as_by_expressions(spark):
    rng = random.Random(6)
    words = ["student", "graduate", "dean", "policy", "family", "study", "academic study", "teacher", "other", "undergraduate"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(8)))) for i in range(80)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    by_plan = df.select("id", classify.stakeholder(F.lit(None).cast("string"), F.col("t")).alias("s")).select("id", "s.*").collect()
    by_table = terms.best_group(df, terms.dictionary(spark, classify.STAKEHOLDER_TERMS), F.lower("t")).select("id", "label", "confidence").collect()
    assert sorted(map(tuple, by_plan)) == sorted(map(tuple, by_table))


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    df = spark.createDataFrame([(1, "term5 term77777 and term99999x")], "id long, t string")

    def counted(n):
        d = spark.range(n).select(F.lit("g").alias("name"), F.lit(0).alias("place"), F.concat(F.lit("term"), F.col("id").cast("string"), F.lit("x")).alias("term"))
        return terms.count_terms(df, d, F.col("t"))

    small, large = counted(10), counted(100_000)
    assert large.first()["hits"] == [(0, 1)]
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert size(large) < size(small) + 50
