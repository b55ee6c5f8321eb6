"""One row per key: preference rules over competing label rows, duplicates, the merged corpus.

Everything is an aggregation by max_by/min_by over an ordering struct, so rows
are combined before they are shuffled; no window sorts whole groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE = "baseline_keyword"
PREFERRED_SENTIMENT = "roberta_news_v2"
COMMENT_METHOD = "hartmann_3"
SENTIMENTS = ("positive", "neutral", "negative")


def pick(df: DataFrame, key: str | Sequence[str], *order: Column, first: bool = False) -> DataFrame:
    """The row of each key with the greatest (``first``: smallest) order values; all its columns."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    chosen = (F.min_by if first else F.max_by)(F.struct(*rest), rank).alias("__row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def best_classification(df: DataFrame, key: str = "article_id") -> DataFrame:
    """Any other classifier beats the keyword baseline, then the newest wins (NULL oldest), then the lowest id."""
    return pick(df, key, F.col("classifier") != BASELINE, F.coalesce(F.col("classified_at").cast("string"), F.lit("")), -F.col("id"))


def newest(df: DataFrame, key: str = "article_id", order: str = "id") -> DataFrame:
    return pick(df, key, F.col(order))


def preferred_sentiment(df: DataFrame, key: str = "article_id") -> DataFrame:
    """The preferred method's rows first, then the highest id."""
    return pick(df, key, F.col("method") == PREFERRED_SENTIMENT, F.col("id"))


def most_confident_classification(df: DataFrame, key: str = "article_id") -> DataFrame:
    """A real classifier first, then the highest confidence, then the lowest id."""
    return pick(df, key, F.col("classifier") != BASELINE, F.coalesce("confidence", F.lit(-1.0)), -F.col("id"))


def unique_by_hash(df: DataFrame, hash_col: str = "content_hash", id_col: str = "id") -> DataFrame:
    """The lowest id of each content hash; rows without a hash are never duplicates."""
    has = F.trim(F.coalesce(F.col(hash_col), F.lit(""))) != ""
    lowest = pick(df.where(has), hash_col, F.col(id_col), first=True)
    return lowest.unionByName(df.where(~has))


def comment_counts(comments: DataFrame, method: str = COMMENT_METHOD) -> DataFrame:
    """Counts of the three labels for each article that has rows of the method; zeros if none of its labels is known."""
    return comments.where(F.col("method") == method).groupBy("article_id").agg(*[F.count_if(F.col("sentiment") == s).cast("long").alias(s) for s in SENTIMENTS])


def merged_corpus(articles: DataFrame, classifications: DataFrame, topics: DataFrame, sentiments: DataFrame, stances: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per analysable article with its labels; an article without comment rows has NULL counts."""
    base = articles.where("llm_relevant AND processing_status = 'success'").select("id", "title", "source", "url", "published_date", F.coalesce("clean_content", F.lit("")).alias("clean_content"))
    label = best_classification(classifications).select(F.col("article_id").alias("id"), "source_type", F.col("stakeholder_category").alias("stakeholder"))
    topic = newest(topics).select(F.col("article_id").alias("id"), "stable_topic_id", F.when(F.col("stable_topic_id") != "", F.coalesce(F.nullif("topic", F.lit("")), "stable_topic_id")).alias("topic"))
    sentiment = preferred_sentiment(sentiments).select(F.col("article_id").alias("id"), "sentiment")
    stance = newest(stances).select(F.col("article_id").alias("id"), "stance")
    counts = comment_counts(comments).select(F.col("article_id").alias("id"), F.struct(*SENTIMENTS).alias("comment_sentiment"))
    for part in (label, topic, sentiment, stance, counts):
        base = base.join(part, "id", "left")
    return base


# --- tables as they stand after a write ---------------------------------------------------------


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: new keys only, the first of each key by ``order``, none without a key."""
    fresh = pick(incoming.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), key, F.col(order), first=True)
    return fresh.join(target.select(key), key, "left_anti").select(*incoming.columns)


def upsert(target: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The target with rows replaced or added; the last of each key by ``order`` counts."""
    latest = pick(incoming, key, F.col(order))
    return target.join(latest.select(*key), list(key), "left_anti").select(*target.columns).unionByName(latest.select(*target.columns))


def append_missing(done: DataFrame, labelled: DataFrame, key: Sequence[str] = ("article_id", "method")) -> DataFrame:
    """Labelled rows whose key is not there yet; existing rows are never touched."""
    return labelled.join(done.select(*key), list(key), "left_anti")


def write_once(current: Column, verdict: Column) -> Column:
    """A verdict is set only where there is none."""
    return F.coalesce(current, verdict)


def tally(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys are new and how many were there before."""
    keys = incoming.where(F.col(key).isNotNull()).select(key).distinct()
    marked = keys.join(existing.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.agg(F.count_if(F.col("__there").isNull()).cast("long").alias("inserted"), F.count_if("__there").cast("long").alias("preserved"))
