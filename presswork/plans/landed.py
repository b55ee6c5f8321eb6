"""Queries for readers and writers of landed files: the given tables are written as a source would land them, and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.plans.registry import Registry
from presswork.session import scratch, table
from presswork.sources import feeds, files, replies, threads

R = Registry()
EDGES = "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$"
DAY = "DATE '2026-01-01' + (doc_id % 300)::INTEGER"


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int")))


def landed(rows: DataFrame, tag: str, packed: str = "none") -> str:
    """The one text column of ``rows`` as lines of files, ``packed`` as said, and where they lie."""
    path = scratch(rows.sparkSession, tag)
    rows.write.text(path, compression=packed)
    return path


def news(spark, d, packed="none") -> str:
    """A reply a line, with one article each; every article of a German document has its text as description."""
    german = F.col("lang") == "de"
    article = F.struct(
        F.col("lang").alias("title"), F.struct(F.col("source").alias("name")).alias("source"), F.concat(F.lit("https://n.example/"), F.col("doc_id")).alias("url"), F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("publishedAt"),
        F.when(~german, F.col("text")).alias("content"), F.when(german, F.col("text")).alias("description"),
    )
    return landed(day(table(spark, d, "documents")).select(F.to_json(F.struct(F.array(article).alias("articles")))), "news", packed)


def platform(spark, d, packed="none") -> str:
    fields = F.map_filter(F.create_map(F.lit("bodyText"), F.col("text"), F.lit("byline"), F.col("source"), F.lit("shortUrl"), F.concat(F.lit("https://o.example/p/x"), F.col("doc_id")), F.lit("commentable"), F.when(F.col("lang") == "en", "true").when(F.col("lang") == "fr", "false")), lambda k, v: v.isNotNull())
    result = F.struct(F.col("lang").alias("webTitle"), F.concat(F.lit("https://o.example/"), F.col("doc_id")).alias("webUrl"), F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("webPublicationDate"), fields.alias("fields"))
    return landed(day(table(spark, d, "documents")).select(F.to_json(F.struct(F.struct(F.array(result).alias("results")).alias("response")))), "platform", packed)


def feed(spark, d, packed="none") -> str:
    """A channel a line; French documents' channels have no title."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("&#10;"))
    item = F.concat(F.lit("<item><title>"), F.col("lang"), F.lit("</title><link>https://r.example/"), F.col("doc_id"), F.lit("</link><pubDate>"), F.date_format("day", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate><description>"), escaped(F.col("text")), F.lit("</description></item>"))
    channel = F.concat(F.lit("<channel>"), F.when(F.col("lang") != "fr", F.concat(F.lit("<title>"), F.col("source"), F.lit("</title>"))).otherwise(""), F.lit("<link>https://r.example/</link>"), item, F.lit("</channel>"))
    return landed(day(table(spark, d, "documents")).select(channel), "feed", packed)


SHAPE = "title, author, source, url, strftime(day, '%Y-%m-%d') AS day, content, discussion_key, commentable"
NEWS = f"SELECT lang AS title, NULL::VARCHAR AS author, source, 'https://n.example/' || doc_id AS url, {DAY} AS day, text AS content, NULL::VARCHAR AS discussion_key, NULL::BOOLEAN AS commentable FROM documents"
OPEN = f"SELECT lang AS title, source AS author, 'open platform' AS source, 'https://o.example/' || doc_id AS url, {DAY} AS day, text AS content, '/p/x' || doc_id AS discussion_key, CASE lang WHEN 'en' THEN TRUE WHEN 'fr' THEN FALSE END AS commentable FROM documents"
RSS = f"SELECT lang AS title, NULL::VARCHAR AS author, CASE WHEN lang = 'fr' THEN 'https://r.example/' ELSE source END AS source, 'https://r.example/' || doc_id AS url, {DAY} AS day, regexp_replace(text, '{EDGES}', '', 'g') AS content, NULL::VARCHAR AS discussion_key, NULL::BOOLEAN AS commentable FROM documents"


def shaped(df: DataFrame, *more: str) -> DataFrame:
    return df.select("title", "author", "source", "url", F.date_format("published_date", "yyyy-MM-dd").alias("day"), "content", "discussion_key", "commentable", *more)


@R.add("s3_news_replies", f"SELECT {SHAPE} FROM ({NEWS})")
def news_replies(spark, d):
    return shaped(feeds.news_api(spark, news(spark, d), lines=True))


@R.add("s4_feed_items", f"SELECT {SHAPE} FROM ({RSS})")
def feed_items(spark, d):
    return shaped(feeds.rss(spark, feed(spark, d), lines=True))


@R.add("s5_open_platform", f"SELECT {SHAPE} FROM ({OPEN})")
def open_platform(spark, d):
    return shaped(feeds.open_platform(spark, platform(spark, d), lines=True))


@R.add("s6_fetch_all", f"SELECT {SHAPE}, 'news_api' AS fetched_from FROM ({NEWS}) UNION ALL SELECT {SHAPE}, 'open_platform' FROM ({OPEN})")
def fetch_all(spark, d):
    """Two sources that are there, and one that is not."""
    by_line = {"news_api": functools.partial(feeds.news_api, lines=True), "open_platform": functools.partial(feeds.open_platform, lines=True)}
    paths = {"news_api": news(spark, d), "open_platform": platform(spark, d), "rss": scratch(spark, "nothing")}
    return shaped(feeds.fetch_all(spark, paths, known=feeds.SOURCES | by_line), "fetched_from")


@R.add("f2_replies_source", f"SELECT {SHAPE}, 'news_api' AS fetched_from FROM ({NEWS}) UNION ALL SELECT {SHAPE}, 'open_platform' FROM ({OPEN}) UNION ALL SELECT {SHAPE}, 'rss' FROM ({RSS})")
def replies_source(spark, d):
    """All three sources, packed as they are sent, through the data source for landed replies."""
    paths = {"news_api": news(spark, d, "gzip"), "open_platform": platform(spark, d, "gzip"), "rss": feed(spark, d, "gzip")}
    found = [feeds.articles(replies.read(spark, path, lines="true"), name).withColumn("fetched_from", F.lit(name)) for name, path in paths.items()]
    return shaped(functools.reduce(DataFrame.unionByName, found), "fetched_from")


@R.add("s7_thread_json", """WITH c AS (SELECT conv_id, turn, text, role = 'user' AS visible FROM conversations)
SELECT conv_id AS article_id, conv_id || ':' || turn AS comment_id, (SELECT conv_id || ':' || max(p.turn) FROM c p WHERE p.conv_id = c.conv_id AND p.visible AND p.turn < c.turn GROUP BY p.conv_id) AS parent_comment_id, turn::INTEGER AS recommendation_count FROM c WHERE visible""")
def thread_json(spark, d):
    """Every conversation as a thread whose turns are replies to the turn before, nested as deep as it is long."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text")), asc=False).alias("t"))  # as long as a conversation

    def around(inner, x):
        own = F.to_json(F.struct(F.concat_ws(":", "conv_id", x["turn"]).alias("id"), x["text"].alias("body"), F.when(x["role"] == "user", "visible").otherwise("blocked").alias("status"), x["turn"].cast("int").alias("numRecommends")))
        return F.concat(F.lit("["), F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"responses":'), inner, F.lit("}]"))

    nested = F.aggregate("t", F.lit("[]"), around)
    level = turns.select(F.col("conv_id").alias("article_id"), nested.alias("comments"))
    return threads.flatten_threads(level).select("article_id", "comment_id", "parent_comment_id", "recommendation_count")


@R.add("s15_labelled_file", """SELECT doc_id::VARCHAR AS article_id, CASE toxic WHEN 1 THEN 'against – “no”' ELSE 'favor – it’s €' END AS human_stance FROM labels""")
def labelled_file(spark, d):
    """A person's labels as a spreadsheet saves them: semicolons and cp1252."""
    said = F.when(F.col("toxic") == 1, "against \x96 \x93no\x94").otherwise("favor \x96 it\x92s \x80")  # these bytes of cp1252 are control characters of ISO-8859-1
    path = scratch(spark, "labels")
    table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), said.alias("human_stance")).write.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    return files.read_labelled(spark, path).drop("line")


@R.add("s16_topic_outputs", "SELECT lang AS topic_id, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'assigned', count(*) FROM documents UNION ALL SELECT 'loaded', count(*) FROM documents")
def topic_outputs(spark, d):
    docs, path = table(spark, d, "documents"), scratch(spark, "topics")
    sizes = docs.groupBy(F.col("lang").alias("topic_id")).agg(F.count("*").alias("n"))
    files.write_topic_outputs(sizes, docs.select("doc_id", F.col("lang").alias("topic_id")), docs.agg(F.count("*").alias("loaded")), path)
    again = spark.read.csv(f"{path}/topics", header=True, schema="topic_id string, n long")
    assigned = spark.read.parquet(f"{path}/assignments").agg(F.count("*").alias("n")).select(F.lit("assigned").alias("topic_id"), "n")
    return again.unionByName(assigned).unionByName(spark.read.json(f"{path}/manifest").select(F.lit("loaded").alias("topic_id"), F.col("loaded").alias("n")))


@R.add("s17_newest_snapshot", "SELECT event_id AS run_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def newest_snapshot(spark, d):
    path = scratch(spark, "snapshots")
    files.append_snapshot(table(spark, d, "events").select(F.col("event_id").alias("run_id"), "value", F.col("ts").alias("generated_at")), path)
    return files.latest_snapshot(spark, path).select("run_id", "value")
