"""Label shares and breakdowns over one merged row per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_counts(label: str | Column, labels: Sequence[str]) -> list[Column]:
    """A count column for each label of a closed domain, and ``total``.

    Rows whose label is NULL or outside the domain count nowhere.
    """
    c = F.col(label) if isinstance(label, str) else label
    return [F.count_if(c == v).cast("long").alias(v) for v in labels] + [F.count_if(c.isin(*labels)).cast("long").alias("total")]


def breakdown(df: DataFrame, group: Column, label: str, labels: Sequence[str], name: str = "label") -> DataFrame:
    """Label counts per group; rows without a group or a known label are left out.

    The order is carried as ``position`` (1 is first): total descending, then name.
    """
    counted = (
        df.where(F.col(label).isin(*labels))
        .withColumn("__g", group)
        .where(F.col("__g").isNotNull() & (F.col("__g") != ""))
        .groupBy(F.col("__g").alias(name))
        .agg(*label_counts(label, labels))
    )
    return with_position(counted, F.desc("total"), F.asc(name))


def with_position(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``position``, the 1-based place under ``order``; meant for small
    aggregated tables (one row per group, not per document)."""
    from pyspark.sql import Window

    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


UNDETERMINED = "undetermined"
MIN_TO_NAME = 20


def shares(df: DataFrame, label: str, labels: Sequence[str], reason: str) -> DataFrame:
    """One row: ``analysed`` (rows with a known label), a share per label (0 when there are none) and ``reason`` when empty."""
    counted = df.agg(*label_counts(label, labels))
    part = [F.round(F.when(F.col("total") > 0, F.col(v) / F.col("total")).otherwise(0.0), 6).alias(v) for v in labels]
    return counted.select(F.col("total").alias("analysed"), *part, F.when(F.col("total") == 0, reason).alias("reason"))


def per_month(df: DataFrame, ts: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Label counts per month; undated rows are left out here though they count in the shares."""
    known = df.where(F.col(label).isin(*labels) & F.col(ts).isNotNull())
    return known.groupBy(F.date_format(ts, "yyyy-MM").alias("label")).agg(*label_counts(label, labels))


def most_negative(rows: DataFrame, negative: str, minimum: int = MIN_TO_NAME) -> DataFrame:
    """The breakdown row with the highest negative share among groups of ``minimum`` or more.

    No row unless two groups are that large and the winner has a negative one;
    ties go to the larger total, then to the earlier in the breakdown's order.
    """
    from pyspark.sql import Window

    named = rows.where((F.col("label") != UNDETERMINED) & (F.col("total") >= minimum))
    order = Window.orderBy(F.desc(F.col(negative) / F.col("total")), F.desc("total"), F.asc("label"))
    ranked = named.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("__r", F.row_number().over(order))
    return ranked.where(f"__n >= 2 AND __r = 1 AND `{negative}` > 0").drop("__n", "__r")


def pooled_comments(corpus: DataFrame, counts: str, labels: Sequence[str], reason: str) -> DataFrame:
    """Shares over all comments of all articles, and how many articles have any."""
    totals = corpus.agg(*[F.coalesce(F.sum(f"{counts}.{v}"), F.lit(0)).cast("long").alias(v) for v in labels], F.count_if(sum((F.coalesce(F.col(f"{counts}.{v}"), F.lit(0)) for v in labels), F.lit(0)) > 0).cast("long").alias("comment_articles"))
    total = sum((F.col(v) for v in labels), F.lit(0))
    return totals.select(total.cast("long").alias("comments_analysed"), "comment_articles", *[F.round(F.when(total > 0, F.col(v) / total).otherwise(0.0), 6).alias(v) for v in labels], F.when(total == 0, reason).alias("reason"))


def top_topics(df: DataFrame, id_col: str = "stable_topic_id", label_col: str = "topic", order_col: str = "id") -> DataFrame:
    """Rows per topic id, labelled by its first row, with ``counted`` and ``unassigned`` on every row."""
    from pyspark.sql import Window

    assigned = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
    groups = df.groupBy(F.when(assigned, F.col(id_col)).alias("topic_id")).agg(F.count("*").alias("count"), F.min_by(F.coalesce(F.nullif(F.col(label_col), F.lit("")), F.col(id_col).cast("string")), F.col(order_col)).alias("label"))
    every = Window.partitionBy(F.lit(0))  # over one row per topic
    counted = groups.withColumn("unassigned", F.coalesce(F.sum(F.when(F.col("topic_id").isNull(), F.col("count"))).over(every), F.lit(0))).where("topic_id IS NOT NULL").withColumn("counted", F.sum("count").over(every))
    return with_position(counted, F.desc("count"), F.asc("label")).select("topic_id", "label", "count", "counted", "unassigned", "position")


def with_baseline(df: DataFrame, group: str, label: str, labels: Sequence[str]) -> DataFrame:
    """The breakdown and, by one rollup, the row of all groups (``is_baseline``)."""
    known = df.where(F.col(label).isin(*labels))
    out = known.rollup(group).agg(*label_counts(label, labels), F.grouping(group).alias("g"))
    return out.select(F.when(F.col("g") == 1, "All").otherwise(F.col(group)).alias("label"), *labels, "total", (F.col("g") == 1).alias("is_baseline"))


OUTLIER_PREFIX = "-1"
TOP_TOPICS, NEWEST_ROWS = 10, 200


def distribution(df: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """(label, n, share) of each known label that occurs, and of all other labels as ``other``; blank labels count nowhere."""
    name = F.lower(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))))
    counts = df.where(name != "").groupBy(F.when(name.isin(*labels), name).otherwise("other").alias("label")).agg(F.count("*").alias("n"))  # a row a label
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def most_common(df: DataFrame, topic: str, limit: int = TOP_TOPICS) -> DataFrame:
    """The ``limit`` most common topic labels (count, then name), with ``counted``: the rows of all of them. Blank and outlier topics count nowhere."""
    name = F.trim(F.coalesce(F.col(topic).cast("string"), F.lit("")))
    counts = df.where((name != "") & ~F.startswith(name, F.lit(OUTLIER_PREFIX))).groupBy(name.alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("label")).limit(limit).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("counted"))))


def newest_rows(df: DataFrame, ts: str, key: str, limit: int = NEWEST_ROWS) -> DataFrame:
    """The newest ``limit`` rows, undated last, ties by key."""
    return df.orderBy(F.desc_nulls_last(ts), F.asc(key)).limit(limit)
