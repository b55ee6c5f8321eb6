"""Queries for shares, breakdowns and periods: ``orders`` are documents with a three-valued label, ``customer`` their topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators import figures, merge, timeseries
from presswork.plans.registry import Registry
from presswork.session import table

R = Registry()
LABELS = ("O", "F", "P")


COUNTS = ", ".join(f"count(*) FILTER (sentiment='{v}') AS \"{v}\"" for v in LABELS) + ", count(*) FILTER (sentiment IN ('O','F','P')) AS total"
CORPUS = """WITH c AS (SELECT o_orderkey AS id, o_orderdate AS published_date, o_orderpriority AS stakeholder, o_orderstatus AS sentiment, c_mktsegment AS topic, o_totalprice AS price
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
MONTHS = f"{CORPUS}, m AS (SELECT strftime(published_date, '%Y-%m') AS label, {COUNTS} FROM c WHERE sentiment IN ('O','F','P') AND published_date IS NOT NULL GROUP BY 1)"


def corpus(spark, d):
    topics = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic"))
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_date"), F.col("o_orderpriority").alias("stakeholder"), F.col("o_orderstatus").alias("sentiment"), F.col("o_totalprice").alias("price"))
    return orders.join(topics, F.col("o_custkey") == F.col("c_custkey"), "left").drop("o_custkey", "c_custkey")


def months(spark, d):
    return figures.per_month(corpus(spark, d), "published_date", "sentiment", LABELS)


def share_sql(counts: str = "total") -> str:
    return ", ".join(f"round(CASE WHEN {counts} > 0 THEN \"{v}\" / {counts}::DOUBLE ELSE 0 END, 6) AS \"{v}\"" for v in LABELS)


@R.add("a1_label_shares", f"{CORPUS}, n AS (SELECT {COUNTS} FROM c) SELECT total AS analysed, {share_sql()}, CASE WHEN total = 0 THEN 'No labels yet.' END AS reason FROM n")
def label_shares(spark, d):
    return figures.shares(corpus(spark, d), "sentiment", LABELS, "No labels yet.")


@R.add("a2_labels_per_month", f"{MONTHS} SELECT * FROM m")
def labels_per_month(spark, d):
    return months(spark, d)


@R.add("a3_topic_breakdown", f"{CORPUS} SELECT topic AS label, {COUNTS}, row_number() OVER (ORDER BY count(*) DESC, topic) AS position FROM c WHERE sentiment IN ('O','F','P') AND topic <> '' GROUP BY topic")
def topic_breakdown(spark, d):
    return figures.breakdown(corpus(spark, d), F.col("topic"), "sentiment", LABELS)


@R.add(
    "a4_stakeholder_breakdown",
    f"""{CORPUS}, n AS (SELECT CASE WHEN stakeholder = '5-LOW' THEN 'undetermined' ELSE stakeholder END AS label, sentiment FROM c WHERE sentiment IN ('O','F','P'))
SELECT label, {COUNTS}, row_number() OVER (ORDER BY count(*) DESC, label) AS position FROM n GROUP BY label""",
)
def stakeholder_breakdown(spark, d):
    rows = corpus(spark, d).withColumn("stakeholder", F.when(F.col("stakeholder") == "5-LOW", "").otherwise(F.col("stakeholder")))
    return figures.breakdown(rows, F.coalesce(F.nullif("stakeholder", F.lit("")), F.lit(figures.UNDETERMINED)), "sentiment", LABELS)


@R.add(
    "a5_most_negative_topic",
    f"""{CORPUS}, b AS (SELECT topic AS label, {COUNTS} FROM c WHERE sentiment IN ('O','F','P') AND topic <> '' GROUP BY topic),
b2 AS (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS position FROM b),
n AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY "P" / total::DOUBLE DESC, total DESC, label) AS r FROM b2 WHERE total >= 20)
SELECT label, "O", "F", "P", total, position FROM n WHERE k >= 2 AND r = 1 AND "P" > 0""",
)
def most_negative_topic(spark, d):
    return figures.most_negative(topic_breakdown(spark, d), "P")


@R.add("a6_stance_shares", f"""{CORPUS}, n AS (SELECT count(*) FILTER (sentiment='F') AS "F", count(*) FILTER (sentiment='P') AS "P", count(*) FILTER (sentiment IN ('F','P')) AS total FROM c)
SELECT total AS analysed, round("F" / total::DOUBLE, 6) AS "F", round("P" / total::DOUBLE, 6) AS "P", CASE WHEN total = 0 THEN 'No stance results yet.' END AS reason FROM n""")
def stance_shares(spark, d):
    return figures.shares(corpus(spark, d), "sentiment", ("F", "P"), "No stance results yet.")


def comments(spark, d):
    """``lineitem`` as label rows of comments: the line status is the method, the return flag the label."""
    names = F.create_map(*[F.lit(x) for x in ("A", "positive", "N", "neutral", "R", "negative")])
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), names[F.col("l_returnflag")].alias("sentiment"), F.when(F.col("l_linestatus") == "F", merge.COMMENT_METHOD).otherwise("other").alias("method"))


COMMENT_COUNTS = "SELECT l_orderkey AS article_id, count(*) FILTER (l_returnflag='A') AS positive, count(*) FILTER (l_returnflag='N') AS neutral, count(*) FILTER (l_returnflag='R') AS negative FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey"


@R.add("a7_comment_counts", COMMENT_COUNTS)
def comment_counts(spark, d):
    return merge.comment_counts(comments(spark, d))


@R.add(
    "a8_pooled_comment_shares",
    f"""WITH k AS ({COMMENT_COUNTS}), j AS (SELECT k.* FROM orders LEFT JOIN k ON o_orderkey = article_id),
s AS (SELECT coalesce(sum(positive),0) AS p, coalesce(sum(neutral),0) AS u, coalesce(sum(negative),0) AS g, count(*) FILTER (coalesce(positive,0)+coalesce(neutral,0)+coalesce(negative,0) > 0) AS n FROM j)
SELECT (p+u+g)::BIGINT AS comments_analysed, n AS comment_articles, round(p/(p+u+g)::DOUBLE,6) AS positive, round(u/(p+u+g)::DOUBLE,6) AS neutral, round(g/(p+u+g)::DOUBLE,6) AS negative, CASE WHEN p+u+g = 0 THEN 'none' END AS reason FROM s""",
)
def pooled_comment_shares(spark, d):
    counts = comment_counts(spark, d).select(F.col("article_id").alias("id"), F.struct(*merge.SENTIMENTS).alias("comment_sentiment"))
    merged = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(counts, "id", "left")
    return figures.pooled_comments(merged, "comment_sentiment", merge.SENTIMENTS, "none")


@R.add(
    "a9_top_topics",
    """WITH r AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN '' ELSE n_nationkey::VARCHAR END AS tid, n_name AS topic FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT tid, count(*) AS n, arg_min(topic, id) AS label FROM r WHERE tid <> '' GROUP BY tid)
SELECT tid AS topic_id, label, n AS "count", (SELECT sum(n) FROM g)::BIGINT AS counted, (SELECT count(*) FROM r WHERE tid IS NULL OR tid = '') AS unassigned, row_number() OVER (ORDER BY n DESC, label) AS position FROM g""",
)
def top_topics(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    tid = F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("n_nationkey").cast("string"))
    return figures.top_topics(rows.select(F.col("s_suppkey").alias("id"), tid.alias("stable_topic_id"), F.col("n_name").alias("topic")))


@R.add("a11_matched_and_total", f"{CORPUS} SELECT count(*) FILTER (price > 100000) AS matched, count(*) AS corpus FROM c")
def matched_and_total(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_totalprice") > 100000).cast("long").alias("matched"), F.count("*").alias("corpus"))


@R.add("a24_breakdown_with_baseline", f"{CORPUS} SELECT CASE WHEN grouping(topic) = 1 THEN 'All' ELSE topic END AS label, {COUNTS}, grouping(topic) = 1 AS is_baseline FROM c WHERE sentiment IN ('O','F','P') GROUP BY ROLLUP (topic)")
def breakdown_with_baseline(spark, d):
    return figures.with_baseline(corpus(spark, d), "topic", "sentiment", LABELS)


@R.add(
    "a26_distribution_with_other",
    """WITH g AS (SELECT CASE WHEN o_orderstatus IN ('O','F') THEN o_orderstatus ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(n / (SELECT sum(n) FROM g)::DOUBLE, 6) AS share FROM g""",
)
def distribution_with_other(spark, d):
    rows = figures.distribution(table(spark, d, "orders"), "o_orderstatus", ("o", "f"))
    return rows.select(F.when(F.col("label") == "other", "other").otherwise(F.upper("label")).alias("label"), "n", "share")


@R.add("a26_most_common", "SELECT p_type AS label, count(*) AS n, (SELECT count(*) FROM part WHERE p_type <> '')::BIGINT AS counted FROM part WHERE p_type <> '' GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def most_common(spark, d):
    return figures.most_common(table(spark, d, "part"), "p_type")


@R.add("a26_newest_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 200")
def newest_rows(spark, d):
    return figures.newest_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@R.add("o3_by_negative_share", f"""{CORPUS}, b AS (SELECT topic AS label, {COUNTS} FROM c WHERE sentiment IN ('O','F','P') AND topic <> '' GROUP BY topic)
SELECT label, total, round("P" / total::DOUBLE, 6) AS negative_share, row_number() OVER (ORDER BY "P" / total::DOUBLE DESC, total DESC, label) AS position FROM b""")
def by_negative_share(spark, d):
    rows = topic_breakdown(spark, d).drop("position")
    return figures.with_position(rows, F.desc(F.col("P") / F.col("total")), F.desc("total"), F.asc("label")).select("label", "total", F.round(F.col("P") / F.col("total"), 6).alias("negative_share"), "position")


# --- periods ---------------------------------------------------------------------------------

#: Few documents meet this, so that some months have none.
RARE = "price > 490000"


def rare_months(spark, d):
    return figures.per_month(corpus(spark, d).where(RARE), "published_date", "sentiment", LABELS)


RARE_MONTHS = MONTHS.replace("AND published_date IS NOT NULL", f"AND published_date IS NOT NULL AND {RARE}")


@R.add("t1_month_buckets", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_buckets(spark, d):
    return table(spark, d, "orders").groupBy(timeseries.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


AXIS = "SELECT strftime(x, '%Y-%m') AS label FROM (SELECT unnest(generate_series((min(label) || '-01')::DATE, (max(label) || '-01')::DATE, INTERVAL {step} MONTH)) AS x FROM {of})"


@R.add(
    "t2_t3_gap_filled_shares",
    f"{RARE_MONTHS}, a AS ({AXIS.format(step=1, of='m')}), j AS (SELECT a.label, coalesce(total, 0) AS total, coalesce(\"O\", 0) AS \"O\", coalesce(\"F\", 0) AS \"F\", coalesce(\"P\", 0) AS \"P\" FROM a LEFT JOIN m USING (label)) SELECT label, total, {share_sql()} FROM j",
)
def gap_filled_shares(spark, d):
    return timeseries.gap_filled(rare_months(spark, d), LABELS)


QUARTERS = """q AS (SELECT strftime(date_trunc('quarter', (label || '-01')::DATE), '%Y-%m') AS label, sum("O")::BIGINT AS "O", sum("F")::BIGINT AS "F", sum("P")::BIGINT AS "P", sum(total)::BIGINT AS total FROM m GROUP BY 1)"""


@R.add("t4_quarters", f"{MONTHS}, {QUARTERS} SELECT * FROM q")
def quarters(spark, d):
    return timeseries.by_quarter(months(spark, d), LABELS)


@R.add(
    "t4_gap_filled_quarters",
    f"{RARE_MONTHS}, {QUARTERS}, a AS ({AXIS.format(step=3, of='q')}), j AS (SELECT a.label, coalesce(total, 0) AS total, coalesce(\"O\", 0) AS \"O\", coalesce(\"F\", 0) AS \"F\", coalesce(\"P\", 0) AS \"P\" FROM a LEFT JOIN q USING (label)) SELECT label, total, {share_sql()} FROM j",
)
def gap_filled_quarters(spark, d):
    return timeseries.gap_filled(timeseries.by_quarter(rare_months(spark, d), LABELS), LABELS, 3)


SPAN = "(SELECT (substr(max(label),1,4)::INT - substr(min(label),1,4)::INT) * 12 + substr(max(label),6,2)::INT - substr(min(label),6,2)::INT + 1 FROM m)"


@R.add("t5_month_span", f"{MONTHS} SELECT {SPAN}::BIGINT AS span")
def month_span(spark, d):
    return timeseries.month_span(months(spark, d))


@R.add("t6_auto_binned", f"{MONTHS}, {QUARTERS} SELECT *, true AS quarterly FROM q WHERE {SPAN} > 20 UNION ALL SELECT *, false FROM m WHERE {SPAN} <= 20")
def auto_binned(spark, d):
    return timeseries.auto_binned(months(spark, d), LABELS)


@R.add("t7_period_names", f"{MONTHS} SELECT label, strftime((label || '-01')::DATE, '%B %Y') AS month_name, 'Q' || quarter((label || '-01')::DATE) || ' ' || year((label || '-01')::DATE) AS quarter_name FROM m")
def period_names(spark, d):
    return months(spark, d).select("label", timeseries.period_name("label").alias("month_name"), timeseries.period_name("label", True).alias("quarter_name"))


@R.add("t8_durations", """WITH r AS (SELECT user_id AS run_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) SELECT run_id, round(epoch_us(b)/1e6 - epoch_us(a)/1e6, 3) AS seconds FROM r""")
def durations(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return runs.select("run_id", F.round(timeseries.seconds_between("a", "b"), 3).alias("seconds"))


@R.add("t9_small_groups", f"{RARE_MONTHS} SELECT label, total, total < 20 AS faded FROM m")
def small_groups(spark, d):
    return rare_months(spark, d).select("label", "total", timeseries.small_group().alias("faded"))
