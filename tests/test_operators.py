"""Worked values and edge cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.functions import classify, text
from presswork.operators import evaluate, figures, labelling, merge, monitor, search, timeseries, topics

L = ("positive", "neutral", "negative")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_shares(spark):
    df = spark.createDataFrame([(x,) for x in ("positive", "neutral", "neutral", "negative", "odd", None)], "s string")
    assert rows(figures.shares(df, "s", L, "none")) == [(4, 0.25, 0.5, 0.25, None)]
    assert rows(figures.shares(df.where("false"), "s", L, "none")) == [(0, 0.0, 0.0, 0.0, "none")]


def test_most_negative_needs_two_large_groups(spark):
    def made(groups):
        data = [(g, "negative" if i < bad else "neutral") for g, bad, n in groups for i in range(n)]
        df = spark.createDataFrame(data, "g string, s string")
        return rows(figures.most_negative(figures.breakdown(df, F.col("g"), "s", L), "negative").select("label"))

    assert made([("students", 6, 20), ("educators", 2, 20), ("parents", 5, 5)]) == [("students",)]
    assert made([("students", 6, 20), ("parents", 5, 5)]) == []
    assert made([("students", 0, 20), ("educators", 0, 20)]) == []
    assert made([("students", 6, 20), ("undetermined", 20, 20), ("educators", 6, 20)]) == [("educators",)]


def test_pooled_comments(spark):
    df = spark.createDataFrame([((1, 2, 5),), ((1, 0, 1),), (None,)], "c struct<positive:long,neutral:long,negative:long>")
    assert rows(figures.pooled_comments(df, "c", L, "none")) == [(10, 2, 0.2, 0.2, 0.6, None)]


def test_top_topics(spark):
    data = [(i, t, None if t is None else t.title()) for i, t in enumerate(["integrity"] * 3 + ["restrictions"] * 2 + ["adoption"] * 2 + [None] * 3 + [""])]
    df = figures.top_topics(spark.createDataFrame(data, "id int, stable_topic_id string, topic string"))
    assert [(r["label"], r["count"], r["counted"], r["unassigned"]) for r in df.orderBy("position").collect()] == [("Integrity", 3, 7, 4), ("Adoption", 2, 7, 4), ("Restrictions", 2, 7, 4)]


def test_preferences_and_ties(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, 9, "baseline_keyword", dt.datetime(2027, 1, 1)), (2, 9, "model", t), (3, 9, "model", t), (4, 8, "baseline_keyword", None), (5, 8, "baseline_keyword", t)], "id long, article_id long, classifier string, classified_at timestamp")
    assert {r["article_id"]: r["id"] for r in merge.best_classification(df).collect()} == {9: 2, 8: 5}
    df = spark.createDataFrame([(1, 9, "roberta_news_v2"), (2, 9, "vader"), (3, 8, "roberta_news"), (4, 8, "vader")], "id long, article_id long, method string")
    assert {r["article_id"]: r["id"] for r in merge.preferred_sentiment(df).collect()} == {9: 1, 8: 4}


def test_hash_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, " ")], "id long, content_hash string")
    assert sorted(r["id"] for r in merge.unique_by_hash(df).collect()) == [1, 3, 4, 5]


def test_comment_counts_null_and_zero(spark):
    df = spark.createDataFrame([(1, "positive", "hartmann_3"), (2, "weird", "hartmann_3"), (3, "positive", "other")], "article_id long, sentiment string, method string")
    assert sorted(rows(merge.comment_counts(df))) == [(1, 1, 0, 0), (2, 0, 0, 0)]


def test_writes_are_idempotent(spark):
    target = spark.createDataFrame([(1, "u1")], "id long, url string")
    new = spark.createDataFrame([(2, "u1"), (3, "u2"), (4, "u2"), (5, None), (6, "")], "id long, url string")
    added = merge.insert_if_absent(target, new, "url", "id")
    assert rows(added) == [(3, "u2")]
    assert rows(merge.insert_if_absent(target.union(added), new, "url", "id")) == []
    up = merge.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, o long"), spark.createDataFrame([(1, "x", 2), (1, "y", 3), (3, "z", 1)], "k long, v string, o long"), ["k"], "o")
    assert sorted(rows(up)) == [(1, "y", 3), (2, "b", 1), (3, "z", 1)]
    assert rows(merge.tally(target, new, "url")) == [(2, 1)]


def test_periods(spark):
    months = spark.createDataFrame([("2025-11", 1, 0, 1, 2), ("2026-02", 0, 4, 0, 4)], "label string, positive long, neutral long, negative long, total long")
    got = rows(timeseries.gap_filled(months, L).orderBy("label"))
    assert [(r[0], r[1]) for r in got] == [("2025-11", 2), ("2025-12", 0), ("2026-01", 0), ("2026-02", 4)]
    assert got[0][2:] == (0.5, 0.0, 0.5)
    five = spark.createDataFrame([(x, 1, 0, 0, 1) for x in ("2025-11", "2025-12", "2026-01", "2026-03", "2026-04")], months.schema)
    assert sorted(r["label"] for r in timeseries.by_quarter(five, L).collect()) == ["2025-10", "2026-01", "2026-04"]
    assert rows(timeseries.month_span(five)) == [(6,)]
    assert rows(timeseries.month_span(five.where("false"))) == [(0,)]
    assert rows(timeseries.gap_filled(five.where("false"), L)) == []
    assert not timeseries.auto_binned(five, L).first()["quarterly"]
    names = spark.createDataFrame([("2026-09",)], "label string").select(timeseries.period_name("label"), timeseries.period_name("label", True))
    assert rows(names) == [("September 2026", "Q3 2026")]
    d = spark.createDataFrame([(3.26,), (42.4,), (125.0,)], "s double").select(timeseries.duration_text("s"))
    assert [r[0] for r in d.collect()] == ["3.3 s", "42 s", "2 m 5 s"]


def test_filters_and_snippets(spark):
    body = "word " * 40 + "Cheating\nin 100%_sure exams " + "tail " * 40
    df = spark.createDataFrame([(1, "A", body, dt.datetime(2026, 1, 2, 23)), (2, "On cheating", "none", None), (3, "B", None, dt.datetime(2026, 1, 3))], "id long, title string, clean_content string, published_date timestamp")
    got = {r["id"]: r["snippet"] for r in search.apply_filters(df, {"q": "cheating"}).collect()}
    assert set(got) == {1, 2} and got[2] is None
    assert got[1].startswith("…") and got[1].endswith("…") and len(got[1]) < 200 and "\n" not in got[1]
    assert [r["id"] for r in search.apply_filters(df, {"q": "100%_SURE"}).collect()] == [1]
    assert sorted(r["id"] for r in search.apply_filters(df, {"from": "2026-01-02", "to": "2026-01-02"}).collect()) == [1]
    assert search.apply_filters(df, {}).count() == 3
    assert [r["id"] for r in df.orderBy(*search.newest_first(df)).collect()] == [3, 1, 2]


def test_comment_search_total(spark):
    comments = spark.createDataFrame([(f"c{i}", 1 if i < 60 else 2, "About AI" if i != 5 else "x", dt.datetime(2026, 1, 1, 0, i % 60), i, i != 6, i == 7) for i in range(70)], "comment_id string, article_id long, body_text string, created_at timestamp, recommendation_count int, screened boolean, quarantined boolean")
    articles = spark.createDataFrame([(1, "T")], "id long, title string")
    got = search.search_comments(comments, articles, "ai").collect()
    assert len(got) == 50 and got[0]["total"] == 57 and {r["article_title"] for r in got} == {"T"}


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    assert rows(search.reproducible_sample(df, "id", 20)) == rows(search.reproducible_sample(df.repartition(7), "id", 20))


def test_kappa(spark):
    pairs = [("favor", "favor")] * 2 + [("against", "against")] * 2 + [("favor", "against"), ("against", "favor")]
    df = spark.createDataFrame([("favor", "favor"), ("favor", "favor"), ("against", "against"), ("against", "favor")], "human string, model string")
    domain = ("favor", "against", "neutral")
    k = evaluate.kappa(evaluate.confusion(df, domain)).first()
    assert (k["compared"], k["accuracy"], k["kappa"]) == (4, 0.75, 0.5)
    same = spark.createDataFrame([("favor", "favor")] * 3, df.schema)
    k = evaluate.kappa(evaluate.confusion(same, domain)).first()
    assert (k["kappa"], k["kappa_undefined"]) == (1.0, True)
    k = evaluate.kappa(evaluate.confusion(df.where("false"), domain)).first()
    assert (k["compared"], k["kappa"], k["kappa_undefined"]) == (0, None, False)
    assert evaluate.confusion(spark.createDataFrame(pairs, df.schema), domain).count() == 9


def test_judged_rows(spark):
    human = spark.createDataFrame([("1 ", "Favor", 1), ("1", "against", 2), ("2", "", 3), ("3", "for", 4), ("4", "neutral", 5)], "article_id string, human_label string, line long")
    model = spark.createDataFrame([(1, "favor"), (2, "favor"), (3, "favor")], "article_id long, model_label string")
    got = evaluate.judged(human, model, ("favor", "against", "neutral"))
    assert [r["outcome"] for r in got.orderBy("line").collect()] == ["compared", "duplicate", "blank", "unknown", "no_model_label"]
    counts = evaluate.outcome_counts(got).first()
    assert counts["unknown_labels"] == ["for"] and counts["compared"] == 1


def test_stakeholder_and_source(spark):
    df = spark.createDataFrame([("Students and teachers", "student"), ("", ""), (None, "dean parent")], "t string, x string")
    got = [tuple(r["s"]) for r in df.select(classify.stakeholder(F.col("t"), F.col("x")).alias("s")).collect()]
    assert got == [("students", 0.667), ("undetermined", 0.0), ("administrators", 0.5)]
    urls = spark.createDataFrame([("https://www.EdWeek.org/a",), ("https://cs.x.edu:8080/",), ("https://me.blog/",), (None,)], "u string")
    assert [tuple(r["s"]) for r in urls.select(classify.source_type(F.col("u")).alias("s")).collect()] == [("news_outlet", 0.95), ("academic", 0.95), ("blog", 0.5), ("blog", 0.5)]
    rel = spark.createDataFrame([("ChatGPT", "in the classroom"), ("email said", "school"), ("AI", "weather")], "t string, x string")
    assert [r[0] for r in rel.select(classify.relevant(F.col("t"), F.col("x"))).collect()] == [True, False, False]


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c("x")).first()[0]
    page = "<html><nav><p>menu menu menu menu menu menu menu menu menu</p></nav><article><p>Short.<p>A paragraph that is longer than forty characters &amp; kept.</p></article></html>"
    assert one(text.article_body, page) == "A paragraph that is longer than forty characters & kept."
    assert one(text.clean_text, " a \t b\n\n\n\nc&amp;d ") == "a b\n\nc&d"
    assert one(text.content_hash, "") is None
    assert str(one(text.parse_date, "Mon, 05 Jan 2026 10:00:00 GMT")) == "2026-01-05 10:00:00"
    assert one(text.parse_date, "soon") is None
    assert str(one(text.parse_utc, "0")) == "1970-01-01 00:00:00"
    assert one(text.lenient_int, "12x") is None
    assert one(text.humanize, "news_outlet") == "News outlet" and one(text.humanize, None) == "—"
    assert one(lambda c: text.parse_reply(c, "stance", ("favor",)), '```json\n{"stance": " Favor ", "confidence": 0.9}\n```').label == "favor"
    assert one(lambda c: text.parse_reply(c, "stance", ("favor",)), "not json").error == "reply is not the JSON asked for"
    assert one(text.slug, "Higher Ed & AI!") == "higher-ed-ai"


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("One two. Three four five. " + long + ". Last one.",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(text.chunks("x", size=10)).collect()]
    assert [c.tokens for c in got[0]] == [5, 10, 10, 5, 2]
    assert not got[1] and not got[2]
    titled = spark.createDataFrame([("body here", "Head")], "x string, t string").select(text.chunks("x", "t")).first()[0]
    assert titled[0].text == "Head. body here"


def test_labelling_stage_is_idempotent(spark):
    articles = spark.createDataFrame([(1, "good"), (2, ""), (3, "bad")], "id long, text string")
    labeller = labelling.RowLabeller("rule", lambda t: ("positive" if t[0] == "g" else "negative", 0.5))
    done = spark.createDataFrame([(3, "x", 1.0, "rule", None)], "article_id long, label string, confidence double, method string, error string")
    first = labelling.run_stage(articles, done, labeller)
    got = {r["article_id"]: (r["label"], r["error"]) for r in first.collect()}
    assert got[1] == ("positive", None) and got[2][0] is None and "IndexError" in got[2][1] and 3 not in got
    assert labelling.run_stage(articles, done.union(first), labeller).count() == 0
    with pytest.raises(RuntimeError):
        labelling.require_some(first.where("label IS NULL"))
    fallback = labelling.ExpressionLabeller("other", F.lit("neutral"), F.lit(0.1))
    mixed = {r["id"]: r["method"] for r in labelling.with_fallback(articles, labeller, fallback).collect()}
    assert mixed == {1: "rule", 2: "other", 3: "rule"}


def test_document_scores_tie_order(spark):
    df = spark.createDataFrame([(1, "negative", 0.5, 10), (1, "positive", 0.5, 10), (1, "neutral", 0.1, 10)], "doc_id long, label string, score double, tokens int")
    assert labelling.document_scores(df).first()["sentiment"] == "positive"


def test_topics(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [-1.0, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    model = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic_id int, centroid array<double>")
    assert {r["vec_id"]: r["topic_id"] for r in topics.assign(vectors, model, 0.5).collect()} == {1: 0, 2: 1, 3: -1}
    with pytest.raises(ValueError):
        topics.discover(vectors, 2)


def test_run_outcomes(spark):
    df = spark.createDataFrame([(1, "collection", "failed"), (1, "topic", "succeeded"), (2, "topic", "failed"), (2, "stance", "succeeded"), (3, "topic", "failed"), (4, "topic", "succeeded")], "run_id long, stage_name string, status string")
    assert {r["run_id"]: r["status"] for r in monitor.run_outcome(df).collect()} == {1: "failed", 2: "completed_with_errors", 3: "failed", 4: "completed"}


def test_dense_topics_find_their_number(spark):
    import numpy as np

    from presswork.operators import topics

    r = np.random.default_rng(4)
    centres = np.eye(8)[:4] * 3
    rows = [(i, (centres[i % 4] + r.normal(0, 0.15, 8)).tolist()) for i in range(400)] + [(1000 + i, r.normal(0, 1, 8).tolist()) for i in range(15)]
    got = topics.discover_dense(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_topic = {}
    for x in got:
        if x["vec_id"] < 1000:
            by_topic.setdefault(x["topic_id"], set()).add(x["vec_id"] % 4)
    real = {t: c for t, c in by_topic.items() if t >= 0}
    assert len(real) == 4 and all(len(c) == 1 for c in real.values())  # one region for each centre, none shared
    assert sum(x["topic_id"] >= 0 for x in got if x["vec_id"] < 1000) > 350
    with pytest.raises(ValueError):
        topics.discover_dense(spark.createDataFrame(rows[:9], "vec_id long, embedding array<double>"))


def test_topic_models_in_blocks(spark, monkeypatch):
    from presswork.operators import topics

    vectors = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    model = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0])], "topic_id int, centroid array<double>")
    whole = {r["vec_id"]: r["topic_id"] for r in topics.assign(vectors, model).collect()}
    monkeypatch.setattr(topics, "MODEL_BLOCK", 1)
    assert {r["vec_id"]: r["topic_id"] for r in topics.assign(vectors, model).collect()} == whole == {i: i % 3 for i in range(9)}


def test_chunks_under_another_counter(spark):
    from presswork.functions import text

    df = spark.createDataFrame([(1, "One two. Three four five. Six. " + "x " * 12 + ". Last one."), (2, ""), (3, None)], "id long, t string")
    by_udf = F.pandas_udf(lambda col: col.map(lambda a: [len(t.split()) for t in a]), "array<int>")
    own = {r["id"]: [(c["text"], c["tokens"]) for c in r["c"]] for r in df.select("id", text.chunks("t", size=5).alias("c")).collect()}
    other = {r["id"]: [(c["text"], c["tokens"]) for c in r["chunks"]] for r in text.chunked(df, "t", size=5, count=by_udf).collect()}
    assert own == other
    assert own[1][:2] == [("One two. Three four five.", 5), ("Six.", 1)] and own[1][-1] == ("Last one.", 2) and own[2] == own[3] == []
    titled = df.where("id = 1").select(text.chunks("t", title=F.lit(" Head "), size=5).alias("c")).first()["c"]
    assert titled[0]["text"].startswith("Head. One two.")
    assert [c["tokens"] for c in df.where("id = 1").select(text.windows("t", 10).alias("c")).first()["c"]] == [10, 10, 1]


def test_runs_over_several_days(spark):
    from presswork.operators import monitor

    runs = spark.sql("SELECT 1 AS run_id, TIMESTAMP '2026-01-01 22:00:00' AS started_at, TIMESTAMP '2026-01-03 01:00:00' AS finished_at UNION ALL SELECT 2, TIMESTAMP '2026-01-02 00:00:00', TIMESTAMP '2026-01-02 00:00:00'")
    written = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2026-01-01 22:00:00'), (2, TIMESTAMP '2026-01-02 00:00:00'), (3, TIMESTAMP '2026-01-03 01:00:01') AS t(article_id, written_at)")
    got = {r["run_id"]: (r["written"], r["covered"]) for r in monitor.coverage(runs, written, spark.sql("SELECT 1 AS article_id")).collect()}
    assert got == {1: (2, 1), 2: (1, 0)}
