"""Landed replies as a data source, read as a table and as a stream."""

import gzip
import json
import os
import time

import pytest

from presswork.sources import feeds, replies


def reply(url, title="t"):
    return json.dumps({"articles": [{"title": title, "url": url, "publishedAt": "2026-01-02T00:00:00Z", "content": "é" * 40, "source": {"name": "s"}}]}, ensure_ascii=False)


@pytest.mark.parametrize("split", [1, 7, 64, 200, 1 << 20])
def test_every_line_once_however_files_are_cut(spark, tmp_path, split):
    lines = ["x" * (i % 23) + "é" * (i % 3) for i in range(60)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode() + b"\n\n")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbffirst\r\nlast without end \xff")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no")
    (tmp_path / "d.txt.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    landed = replies.Landed({"path": str(tmp_path), "lines": "true", "split_bytes": split})
    got = [(os.path.basename(f), p) for part in landed.cut(landed.files()) for b in landed.read(part) for f, p in zip(b["file"].to_pylist(), b["payload"].to_pylist(), strict=True)]
    want = [("a.txt", x) for x in lines if x] + [("b.txt", "first"), ("b.txt", "last without end �"), ("d.txt.gz", "one"), ("d.txt.gz", "two")]
    assert got == want
    places = [p for part in landed.cut(landed.files()) for b in landed.read(part) for p in b["place"].to_pylist()]
    assert places[0] == len(lines[0]) + 1 and places == sorted(places[: len(places) - 4]) + places[-4:]


def test_read_as_articles(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([reply("u1"), "{broken", reply("u2"), "null", ""]))
    (tmp_path / "b.json").write_text(reply("u3"))
    df = replies.read(spark, str(tmp_path), lines="true", split_bytes=50)
    assert df.rdd.getNumPartitions() > 3
    want = feeds.news_api(spark, str(tmp_path), lines=True).collect()
    got = feeds.articles(df, "news_api").collect()
    assert sorted(got) == sorted(want) and {r["url"] for r in got} == {"u1", "u2", "u3"}
    with pytest.raises(ValueError):
        feeds.articles(df, "radio")


def test_whole_files_and_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<?xml version="1.0"?>\n<rss version="2.0">\n<channel>\n<title>Feed</title><link>l</link>\n<item><title>A</title><link>u</link></item>\n<item><title>B</title><link>v</link></item></channel></rss>')
    got = feeds.articles(replies.read(spark, f"file://{tmp_path}"), "rss").collect()
    assert {(r["title"], r["url"], r["source"]) for r in got} == {("A", "u", "Feed"), ("B", "v", "Feed")}


def test_nothing_landed(spark, tmp_path):
    assert replies.read(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no such path"):
        replies.read(spark, str(tmp_path / "absent")).count()


def test_as_a_stream(spark, tmp_path):
    landed, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()

    def run():
        found = feeds.articles(replies.stream(spark, str(landed), lines="true", quiet_seconds=0.2), "news_api")
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["url"] for r in spark.read.parquet(out).select("url").collect())

    (landed / "1.json").write_text(reply("u1") + "\n" + reply("u2"))
    time.sleep(0.5)
    assert run() == ["u1", "u2"]
    (landed / "2.json").write_text(reply("u3"))
    time.sleep(0.5)
    assert run() == ["u1", "u2", "u3"]
    assert run() == ["u1", "u2", "u3"]  # nothing new, nothing twice
