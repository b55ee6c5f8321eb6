"""Landed files in, safe files out."""

import json

import pytest
from pyspark.sql import functions as F

from presswork.operators.labelling import ExpressionLabeller
from presswork.sources import feeds, files, threads
from presswork.streaming.incremental import label_stream


def test_mixed_import(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text(
        "﻿type;id;post_id;subreddit;specific_subreddit;title;text;created_utc;score;num_comments;stakeholder_group\n"
        "post;p1;;s;;Old;x;1700000000;3;4;students\npost;p1;;s;;New;x;2026-01-01T00:00:00Z;bad;4;students\n"
        "comment;c1;p1;s;sub;;hello;1700000000;1;;parents\ncomment;c2;nope;s;;;lost;;1;;\npost;;;s;;;;;;;\n",
        encoding="utf-8",
    )
    posts, comments, counts = files.read_mixed(spark, str(p), "set1")
    assert [(r["id"], r["title"], r["score"]) for r in posts.collect()] == [("p1", "New", None)]
    assert [(r["id"], r["subreddit"]) for r in comments.collect()] == [("c1", "sub")]
    assert tuple(counts.first()) == (1, 1, 1, 1)


def test_feeds(spark, tmp_path):
    (tmp_path / "news.json").write_text(json.dumps({"articles": [{"title": "A", "source": {"name": "S"}, "url": "u1", "publishedAt": "2026-01-01T00:00:00Z", "content": None, "description": "d"}]}))
    (tmp_path / "open.json").write_text(json.dumps({"response": {"results": [{"webTitle": "B", "webUrl": "u2", "webPublicationDate": "2026-01-02T00:00:00Z", "fields": {"shortUrl": "https://x.y/p/abc1", "commentable": "true", "bodyText": "t"}}, {"webTitle": "C", "webUrl": "u3", "fields": {}}]}}))
    (tmp_path / "feed.xml").write_text("<rss><channel><title>F</title><item><title>D</title><link>u4</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item><item><title>E</title><link>u5</link></item></channel></rss>")
    paths = {"news_api": str(tmp_path / "news.json"), "open_platform": str(tmp_path / "open.json"), "rss": str(tmp_path / "feed.xml")}
    got = {r["url"]: r for r in feeds.fetch_all(spark, paths).collect()}
    assert got["u1"]["content"] == "d" and got["u2"]["discussion_key"] == "/p/abc1" and got["u2"]["commentable"] is True and got["u3"]["commentable"] is None
    assert got["u4"]["source"] == "F" and got["u4"]["published_date"] is not None and got["u5"]["published_date"] is None
    assert feeds.fetch_all(spark, {**paths, "rss": "/no/such"}).count() == 3
    with pytest.raises(ValueError):
        feeds.fetch_all(spark, paths, ["radio"])


def test_threads(spark, tmp_path):
    c = lambda i, s="visible", r=(): {"id": i, "body": f"<p>{i} &amp; co</p>", "status": s, "isoDateTime": "2026-01-01T00:00:00Z", "numRecommends": 1, "userProfile": {"userId": "7"}, "responses": list(r)}
    (tmp_path / "t.json").write_text(json.dumps({"discussion": {"comments": [c("a", r=[c("b", "blocked", [c("d")]), c("e")]), c("f", "blocked", [c("g")])]}}))
    flat = threads.flatten_threads(threads.read_threads(spark, str(tmp_path / "t.json"), F.lit(5)))
    assert {r["comment_id"]: r["parent_comment_id"] for r in flat.collect()} == {"a": None, "d": "a", "e": "a", "g": None}
    assert flat.where("comment_id = 'a'").first()["body_text"] == "a & co"
    edges = spark.createDataFrame([("a", None, True), ("b", "a", False), ("c", "b", False), ("d", "c", True), ("e", "x", True)], "id string, parent string, visible boolean")
    assert {r["id"]: r["parent"] for r in threads.visible_parents(edges).collect()} == {"a": None, "d": "a", "e": "x"}


def test_threads_of_any_depth(spark, tmp_path):
    nested = []
    for i in reversed(range(9)):
        nested = [{"id": f"c{i}", "body": "x", "status": "blocked" if i in (3, 4, 6) else "visible", "responses": nested}]
    (tmp_path / "t.json").write_text(json.dumps({"discussion": {"comments": nested}}))
    flat = threads.flatten_threads(threads.read_threads(spark, str(tmp_path / "t.json"), F.lit(5)))
    assert {r["comment_id"]: r["parent_comment_id"] for r in flat.collect()} == {"c0": None, "c1": "c0", "c2": "c1", "c5": "c2", "c7": "c5", "c8": "c7"}


def test_long_hidden_runs(spark):
    edges = [(0, None, True), *((i, i - 1, i in (1, 150, 280)) for i in range(1, 281)), (901, 902, False), (902, 901, False), (903, 902, True)]
    got = threads.visible_parents(spark.createDataFrame(edges, "id long, parent long, visible boolean"))
    assert {r["id"]: r["parent"] for r in got.collect()} == {0: None, 1: 0, 150: 1, 280: 150, 903: None}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, '=1+1, "x"', None), (2, "-5 reasons", "ok"), (3, "@x", "é")], "id long, title string, stance string")
    out = str(tmp_path / "out")
    files.write_export(df.coalesce(1), out, columns=["id", "title", ("view", "stance")])
    raw = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,title,view\r\n")
    assert b"1,\"'=1+1, \"\"x\"\"\",\r\n" in raw and b"2,'-5 reasons,ok\r\n" in raw


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8-sig", ","), ("latin-1", ";")])
def test_labelled_files(spark, tmp_path, encoding, sep):
    p = tmp_path / "l.csv"
    p.write_text(f"article_id{sep}human_stance{sep}title\n1{sep}favor{sep}café\n", encoding=encoding)
    row = files.read_labelled(spark, str(p)).first()
    assert (row["article_id"], row["human_stance"], row["title"]) == ("1", "favor", "café")
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_labelled(spark, str(p))


def test_labelled_files_of_spreadsheets(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("article_id;human_stance;title\n1;favor;“It’s” – 5 € Œuvre\n".encode("cp1252"))
    assert files.read_labelled(spark, str(p)).first()["title"] == "“It’s” – 5 € Œuvre"


def test_forty_levels_of_replies(spark, tmp_path):
    nested = []
    for i in reversed(range(40)):
        nested = [{"id": f"c{i}", "body": "x", "status": "visible", "responses": nested}]
    (tmp_path / "t.json").write_text(json.dumps({"discussion": {"comments": nested}}))
    assert threads.flatten_threads(threads.read_threads(spark, str(tmp_path / "t.json"), F.lit(5))).count() == 40


def test_broken_replies_are_counted(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"articles": [{"title": "A", "url": "u"}]}\n{"articles": [{"title": \n')
    assert feeds.news_api(spark, str(tmp_path / "r.json"), lines=True).count() == 1
    assert feeds.broken(spark, str(tmp_path / "r.json"), feeds._NEWS, lines=True) == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    for run, day in ((1, "2026-01-01"), (2, "2026-01-02")):
        files.append_snapshot(spark.sql(f"SELECT {run} AS run_id, TIMESTAMP '{day} 01:00:00' AS generated_at"), path)
    assert files.latest_snapshot(spark, path).first()["run_id"] == 2


def test_topic_outputs(spark, tmp_path):
    one = lambda sql: spark.sql(f"SELECT {sql}")
    files.write_topic_outputs(one("0 AS topic_id, 3 AS n, 'a; b' AS topic_keywords"), one("1L AS article_id, 0 AS topic_id"), one("'v1' AS version, 3 AS loaded"), str(tmp_path))
    assert spark.read.csv(str(tmp_path / "topics"), header=True).first()["topic_keywords"] == "a; b"
    assert spark.read.parquet(str(tmp_path / "assignments")).count() == 1 and spark.read.json(str(tmp_path / "manifest")).first()["version"] == "v1"


def test_stream_labels_once(spark, tmp_path):
    landed, results = str(tmp_path / "landed"), str(tmp_path / "results")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, text string").write.parquet(landed)
    rule = ExpressionLabeller("rule", F.lit("neutral"), F.lit(0.5))
    for _ in range(2):
        label_stream(spark, landed, "id long, text string", results, str(tmp_path / "ckpt"), rule).awaitTermination()
        spark.createDataFrame([(2, "b"), (3, "c")], "id long, text string").write.mode("append").parquet(landed)
    assert sorted(r["article_id"] for r in spark.read.parquet(results).collect()) == [1, 2, 3]


def test_labelled_lines_are_numbered_through_all_files(spark, tmp_path):
    for name, ids in (("b", range(30, 40)), ("a", range(25))):
        body = "".join(f'{i};favor;"two\r\nlines {i}"\r\n' for i in ids)
        (tmp_path / f"{name}.csv").write_bytes("﻿article_id;human_stance;note\r\n".encode() + body.encode())
    got = sorted((r["line"], r["article_id"]) for r in files.read_labelled(spark, str(tmp_path)).collect())
    assert got == [(n + 1, str(i)) for n, i in enumerate([*range(25), *range(30, 40)])]
