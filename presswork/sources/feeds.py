"""Landed payloads of news sources as one common article shape."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.text import parse_date

ARTICLE = "title string, author string, source string, url string, published_date timestamp, content string, discussion_key string, commentable boolean"
_NEWS = "articles array<struct<title:string,author:string,source:struct<name:string>,url:string,publishedAt:string,content:string,description:string>>"
_OPEN = "response struct<results:array<struct<webTitle:string,webUrl:string,webPublicationDate:string,fields:map<string,string>>>>"


def _articles(df: DataFrame, **columns: Column) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    shape = _parse_datatype_string(ARTICLE)
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def news_api(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON replies with an ``articles`` list, a file each or (``lines``) a line each; content falls back to the description, then to ''. Broken replies give no rows."""
    return _news_articles(spark.read.schema(_NEWS).option("multiLine", not lines).json(path))


def _news_articles(replies: DataFrame) -> DataFrame:
    rows = replies.select(F.explode("articles").alias("a")).select("a.*")
    return _articles(rows, title=F.col("title"), author=F.col("author"), source=F.col("source.name"), url=F.col("url"), published_date=parse_date("publishedAt"), content=F.coalesce("content", "description", F.lit("")))


_CHANNEL = "title string, link string, item array<struct<title:string,link:string,author:string,pubDate:string,description:string>>"


def rss(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """RSS items, from files of channels or (``lines``) a channel a line; the source is the feed's title, else the feed's address."""
    if lines:
        rows = spark.read.text(path).select(F.from_xml("value", _CHANNEL).alias("c")).select("c.*")
    else:
        rows = spark.read.schema(_CHANNEL).format("xml").option("rowTag", "channel").load(path)
    return _feed_articles(rows)


def _feed_articles(channels: DataFrame) -> DataFrame:
    items = channels.select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "link").alias("feed"), F.explode("item").alias("i"))
    return _articles(items, title=F.col("i.title"), author=F.col("i.author"), source=F.col("feed"), url=F.col("i.link"), published_date=parse_date("i.pubDate"), content=F.coalesce("i.description", F.lit("")))


def open_platform(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Open-platform JSON, a reply a file or (``lines``) a line; the discussion key comes from the short address, and an article is commentable if its fields say so at all."""
    return _open_articles(spark.read.schema(_OPEN).option("multiLine", not lines).json(path))


def _open_articles(replies: DataFrame) -> DataFrame:
    rows = replies.select(F.explode("response.results").alias("r")).select("r.*")
    fields = F.col("fields")
    get = lambda k: F.try_element_at(fields, F.lit(k))
    return _articles(
        rows, title=F.col("webTitle"), author=get("byline"), source=F.lit("open platform"), url=F.col("webUrl"), published_date=parse_date("webPublicationDate"), content=F.coalesce(get("bodyText"), F.lit("")),
        discussion_key=F.nullif(F.regexp_extract(F.coalesce(get("shortUrl"), F.lit("")), r"(/p/[A-Za-z0-9]+)\s*$", 1), F.lit("")), commentable=F.when(F.map_contains_key(fields, "commentable"), F.lower(get("commentable")) == "true"),
    )


Reader = Callable[[SparkSession, str], DataFrame]
SOURCES: dict[str, Reader] = {"news_api": news_api, "rss": rss, "open_platform": open_platform}


def _parsers() -> dict[str, tuple[Column, Callable[[DataFrame], DataFrame]]]:
    """What a payload of each source is parsed to, and how articles come out of that."""
    channel = F.regexp_extract("payload", r"(?s)<channel\b.*</channel>", 0)
    return {
        "news_api": (F.from_json("payload", _NEWS), _news_articles),
        "rss": (F.from_xml(channel, _CHANNEL), _feed_articles),
        "open_platform": (F.from_json("payload", _OPEN), _open_articles),
    }


def articles(replies: DataFrame, source: str) -> DataFrame:
    """Articles of a source from replies in a column ``payload``, be it a table or a stream (``replies.read``, ``replies.stream``). Broken and NULL payloads give no rows."""
    if source not in (known := _parsers()):
        raise ValueError(f"unknown source: {source}")
    parsed, shape = known[source]
    return shape(replies.select(parsed.alias("p")).where("p IS NOT NULL").select("p.*"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) names anything that Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return found is not None and len(found) > 0


def broken(spark: SparkSession, path: str, schema: str, lines: bool = False) -> int:
    """How many replies at a path are no JSON of this schema; readers pass over these."""
    text = spark.read.text(path, wholetext=not lines)
    return text.where(F.trim("value") != "").select(F.from_json("value", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"}).alias("r")).where("r.__broken IS NOT NULL").count()


def fetch_all(spark: SparkSession, paths: Mapping[str, str], sources: Iterable[str] | None = None, known: Mapping[str, Reader] = SOURCES) -> DataFrame:
    """Union of the named sources (all by default). An unknown name is an error; a source without files is left out, broken replies give no rows."""
    names = list(known if sources is None else sources)
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    readable = [n for n in names if n in paths and _exists(spark, paths[n])]
    found = [known[n](spark, paths[n]).withColumn("fetched_from", F.lit(n)) for n in readable]
    if not found:
        return spark.createDataFrame([], ARTICLE + ", fetched_from string")
    return reduce(DataFrame.unionByName, found)
