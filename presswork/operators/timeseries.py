"""Months and quarters: buckets, gap filling, shares, spans, names, durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_LIMIT = 20
SMALL_GROUP = 20


def month(ts: str | Column) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")


def quarter_label(label: str | Column) -> Column:
    """The first month of a month label's quarter."""
    c = F.col(label) if isinstance(label, str) else label
    return F.date_format(F.date_trunc("quarter", F.to_date(F.concat(c, F.lit("-01")))), "yyyy-MM")


def by_quarter(months: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Month rows summed into quarters, labelled by their first month."""
    return months.groupBy(quarter_label("label").alias("label")).agg(*[F.sum(c).cast("long").alias(c) for c in (*labels, "total")])


def share(count: str, total: str = "total") -> Column:
    return F.when(F.col(total) > 0, F.col(count) / F.col(total)).otherwise(0.0)


def gap_filled(periods: DataFrame, labels: Sequence[str], step: int = 1) -> DataFrame:
    """Every period from the first to the last, ``step`` months apart, with shares; periods without rows have total 0."""
    span = periods.agg(F.min("label").alias("a"), F.max("label").alias("b"))
    first = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    axis = span.where("a IS NOT NULL").select(F.explode(F.sequence(first("a"), first("b"), F.expr(f"interval {int(step)} month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("label"))
    filled = axis.join(periods, "label", "left").fillna(0, ["total", *labels])
    return filled.select("label", F.col("total").cast("long").alias("total"), *[F.round(share(c), 6).alias(c) for c in labels])


def month_span(periods: DataFrame) -> DataFrame:
    """One row, ``span``: calendar months from the first label to the last, both included; 0 without rows."""
    y, m = lambda c: F.substring(c, 1, 4).cast("long"), lambda c: F.substring(c, 6, 2).cast("long")
    ends = periods.agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return ends.select(F.coalesce((y("b") - y("a")) * 12 + m("b") - m("a") + 1, F.lit(0)).cast("long").alias("span"))


def auto_binned(months: DataFrame, labels: Sequence[str], limit: int = SPAN_LIMIT) -> DataFrame:
    """Month rows, or quarters once the span is over the limit; ``quarterly`` tells which."""
    both = months.crossJoin(F.broadcast(month_span(months)))  # one row
    quarterly = F.col("span") > limit
    binned = both.withColumn("label", F.when(quarterly, quarter_label("label")).otherwise(F.col("label")))
    return binned.groupBy("label", quarterly.alias("quarterly")).agg(*[F.sum(c).cast("long").alias(c) for c in (*labels, "total")])


def period_name(label: str | Column, quarterly: Column | bool = False) -> Column:
    """'September 2026', or 'Q3 2026'."""
    d = F.to_date(F.concat(F.col(label) if isinstance(label, str) else label, F.lit("-01")))
    q = F.lit(quarterly) if isinstance(quarterly, bool) else quarterly
    return F.when(q, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))).otherwise(F.date_format(d, "MMMM yyyy"))


def seconds_between(start: str, end: str) -> Column:
    """Seconds with fractions; an open end is now."""
    return (F.unix_micros(F.coalesce(F.col(end).cast("timestamp"), F.current_timestamp())) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6


def duration_text(seconds: str | Column) -> Column:
    """Under 10 s with one decimal, under 90 s whole, else minutes and seconds."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    whole = F.floor(s + 0.5)
    return (
        F.when(s < 10, F.concat(F.format_number(s, 1), F.lit(" s"))).when(s < 90, F.concat(whole.cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(" m "), (whole % 60).cast("string"), F.lit(" s")))
    )


def small_group(total: str = "total", limit: int = SMALL_GROUP) -> Column:
    return F.col(total) < limit
