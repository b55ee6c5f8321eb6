"""Filters, keyword search with snippets, comment search, option lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.text import present, snippet
from presswork.session import settle

ARTICLE_FIELDS = ("id", "title", "url", "source", "published_date", "source_type", "stakeholder", "stable_topic_id", "topic", "sentiment", "stance", "snippet")
EXACT = {"source_type": "source_type", "stakeholder": "stakeholder", "topic": "stable_topic_id"}


def analysable(articles: DataFrame) -> DataFrame:
    """Relevant and processed; NULL in either is out."""
    return articles.where("llm_relevant AND processing_status = 'success'")


def eligible(articles: DataFrame, text: str = "clean_content") -> DataFrame:
    """Relevant by both flags, processed, with text."""
    return articles.where("is_relevant AND llm_relevant AND processing_status = 'success'").where(present(text))


def in_days(ts: str, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive range on the day; a row without a date is out once a bound is set."""
    ok = F.lit(True)
    if start:
        ok = ok & (F.to_date(ts) >= F.lit(start).cast("date"))
    if end:
        ok = ok & (F.to_date(ts) <= F.lit(end).cast("date"))
    return F.coalesce(ok, F.lit(False))


def contains_ci(text: str | Column, q: str) -> Column:
    """Case-insensitive substring; every character of q stands for itself."""
    c = F.col(text) if isinstance(text, str) else text
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower()))


def apply_filters(corpus: DataFrame, filters: Mapping[str, str], date: str = "published_date", text: str = "clean_content", title: str = "title", exact: Mapping[str, str] = EXACT) -> DataFrame:
    """Rows that meet every set filter, with ``snippet`` (NULL without q, or where only the title matches)."""
    out = corpus.where(in_days(date, filters.get("from"), filters.get("to"))) if filters.get("from") or filters.get("to") else corpus
    for key, column in exact.items():
        if filters.get(key):
            out = out.where(F.col(column) == filters[key])
    q = filters.get("q")
    if not q:
        return out.withColumn("snippet", F.lit(None).cast("string"))
    return out.where(contains_ci(title, q) | contains_ci(text, q)).withColumn("snippet", snippet(text, q))


def newest_first(df: DataFrame, ts: str = "published_date", key: str = "id") -> list[Column]:
    """Newest first, undated last, ties in the order of ids."""
    return [F.desc_nulls_last(ts), F.asc(key)]


def search_comments(comments: DataFrame, articles: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """The newest ``limit`` matching comments on the given articles, each with the total of all matches, title and snippet.

    Only screened comments that are not in quarantine count. Undated comments
    come last; ties go by comment id.
    """
    passed = comments.where("screened AND NOT quarantined").where(contains_ci("body_text", q))
    titles = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    matched = settle(passed.join(titles, "article_id").select("comment_id", "article_id", "article_title", "created_at", "recommendation_count", "body_text"), "matched")  # found once, read twice
    total = matched.agg(F.count("*").alias("total"))
    top = matched.orderBy(F.desc_nulls_last("created_at"), F.asc("comment_id")).limit(limit)
    return top.crossJoin(F.broadcast(total)).select("comment_id", "article_id", "article_title", "created_at", "recommendation_count", snippet("body_text", q).alias("snippet"), "total")


def filter_options(corpus: DataFrame, columns: Sequence[str], date: str) -> DataFrame:
    """(field, value): the distinct values that filters can offer, and the first and last day."""
    parts = [corpus.where(present(F.col(c).cast("string"))).select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    days = corpus.agg(F.min(F.to_date(date)).alias("a"), F.max(F.to_date(date)).alias("b"))
    parts.append(days.select(F.explode(F.array(F.struct(F.lit("date_min").alias("field"), F.col("a").cast("string").alias("value")), F.struct(F.lit("date_max").alias("field"), F.col("b").cast("string").alias("value")))).alias("s")).select("s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unknown_values(requested: DataFrame, options: DataFrame) -> DataFrame:
    """Requested (field, value) pairs that the options lack; a field without options proves nothing."""
    offered = options.select("field").distinct()
    return requested.join(offered, "field", "left_semi").join(options.select("field", "value"), ["field", "value"], "left_anti")


def recent(df: DataFrame, key: str = "id", limit: int = 20) -> DataFrame:
    """Highest ids first; the limit is held between 1 and 100."""
    return df.orderBy(F.desc(key)).limit(max(1, min(100, limit)))


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Every row with its 1-based place under a total order, without sorting everything in one task.

    Rows are dealt by range, sorted where they lie and numbered inside each
    partition; a table of one count per partition gives the offsets.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id keeps the place in the partition in its low bits
    laid = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    counts = laid.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    joined = laid.join(F.broadcast(offsets), part == F.col("__p"))
    return joined.withColumn(name, F.col("__m").bitwiseAND(F.lit(low)) + F.col("__o") + 1).drop("__m", "__p", "__o")


def running_totals(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Every row with the sums of columns over all rows before it and itself, under an order of the whole table.

    Rows are dealt by range and summed inside their partition; one row of sums
    for each partition gives what came before it. sums: column to name of its total.
    """
    laid = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    parts = laid.groupBy("__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums]).select("__p", *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inside = Window.partitionBy("__p").orderBy("__m")
    within = laid.select("*", *[F.sum(c).over(inside).alias(f"__w_{c}") for c in sums])
    joined = within.join(F.broadcast(parts), "__p")
    return joined.select(*df.columns, *[(F.col(f"__w_{c}") + F.col(f"__o_{c}")).alias(name) for c, name in sums.items()])


def reproducible_sample(df: DataFrame, key: str, n: int | None = 50, seed: int = 42) -> DataFrame:
    """n rows (or all) by a hash of key and seed: the same rows however the data are partitioned."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df if n is None else df.orderBy(order, F.col(key)).limit(n)


def first_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """Up to n rows of each group; Spark cuts each partition to n a group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)
