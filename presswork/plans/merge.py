"""Queries for merges, joins, duplicates and write modes, over ``orders``, ``lineitem``, ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators import merge, monitor
from presswork.plans.registry import Registry
from presswork.session import discard, scratch, settle, table
from presswork.sources import files, keyed

R = Registry()


@R.add("s1_table_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def table_read(spark, d):
    """Predicate and columns reach the Parquet scan; a server's paging has no counterpart."""
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@R.add(
    "s2_mixed_import",
    """SELECT 'post' AS kind, doc_id::VARCHAR AS id, NULL::VARCHAR AS post_id, source AS subreddit, n_chars::INTEGER AS score FROM documents
UNION ALL SELECT 'comment', conv_id || ':' || turn, conv_id::VARCHAR, role, turn::INTEGER FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)""",
)
def mixed_import(spark, d):
    """Documents and conversations as one ;-separated file of posts and comments, imported again."""
    empty = F.lit(None).cast("string")
    shape = lambda df, **c: df.select(*[c.get(n, empty).cast("string").alias(n) for n in files.IMPORT_COLUMNS])
    posts = shape(table(spark, d, "documents"), type=F.lit("post"), id=F.col("doc_id"), subreddit=F.col("source"), title=F.col("lang"), score=F.col("n_chars"))
    comments = shape(table(spark, d, "conversations"), type=F.lit("comment"), id=F.concat_ws(":", "conv_id", "turn"), post_id=F.col("conv_id"), subreddit=F.lit("x"), specific_subreddit=F.col("role"), score=F.col("turn"))
    path = scratch(spark, "import")
    posts.unionByName(comments).write.csv(path, sep=";", header=True)
    p, c, _ = files.read_mixed(spark, path, "tables")
    one = lambda df, kind, post: df.select(F.lit(kind).alias("kind"), "id", post.alias("post_id"), "subreddit", "score")
    return one(p, "post", empty).unionByName(one(c, "comment", F.col("post_id")))


def label_rows(spark, d):
    """``orders`` as competing label rows of a customer: urgent ones come from the preferred method, low ones from the baseline."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("article_id"), F.col("o_orderstatus").alias("sentiment"), F.col("o_orderpriority").alias("stakeholder_category"),
        F.when(F.col("o_orderpriority") == "1-URGENT", merge.PREFERRED_SENTIMENT).otherwise("vader").alias("method"),
        F.when(F.col("o_orderpriority") == "5-LOW", merge.BASELINE).otherwise("model").alias("classifier"), F.col("o_orderdate").alias("classified_at"), F.round(F.col("o_totalprice") / 600000, 3).alias("confidence"),
    )


ROWS = """WITH r AS (SELECT o_orderkey AS id, o_custkey AS article_id, o_orderstatus AS sentiment, o_orderpriority AS stakeholder_category,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'roberta_news_v2' ELSE 'vader' END AS method, CASE WHEN o_orderpriority = '5-LOW' THEN 'baseline_keyword' ELSE 'model' END AS classifier,
  o_orderdate AS classified_at, round(o_totalprice / 600000, 3) AS confidence FROM orders)"""


def best(order: str, columns: str) -> str:
    return f"{ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY {order}) AS rn FROM r) SELECT {columns} FROM k WHERE rn = 1"


@R.add("d1_best_classification", best("(classifier <> 'baseline_keyword') DESC, classified_at DESC NULLS LAST, id ASC", "article_id, id, classifier, stakeholder_category"))
def best_classification(spark, d):
    return merge.best_classification(label_rows(spark, d)).select("article_id", "id", "classifier", "stakeholder_category")


@R.add("d2_newest_topic", best("id DESC", "article_id, id, stakeholder_category"))
def newest_topic(spark, d):
    return merge.newest(label_rows(spark, d)).select("article_id", "id", "stakeholder_category")


@R.add("d3_preferred_sentiment", best("(method = 'roberta_news_v2') DESC, id DESC", "article_id, id, sentiment, method"))
def preferred_sentiment(spark, d):
    return merge.preferred_sentiment(label_rows(spark, d)).select("article_id", "id", "sentiment", "method")


@R.add("d4_newest_stance", best("id DESC", "article_id, sentiment AS stance"))
def newest_stance(spark, d):
    return merge.newest(label_rows(spark, d)).select("article_id", F.col("sentiment").alias("stance"))


HASHES = "WITH h AS (SELECT doc_id AS id, CASE WHEN length(text) > 0 THEN sha256(text) END AS content_hash FROM documents)"


@R.add("d5_unique_by_hash", f"{HASHES} SELECT min(id) AS id, content_hash FROM h WHERE content_hash IS NOT NULL GROUP BY content_hash UNION ALL SELECT id, NULL FROM h WHERE content_hash IS NULL")
def unique_by_hash(spark, d):
    from presswork.functions.text import content_hash

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), content_hash("text").alias("content_hash"))
    return merge.unique_by_hash(rows).select("id", "content_hash")


#: What is stored already and what comes in: finished and unfinished orders.
STORED, INCOMING = "o_orderstatus = 'F'", "o_orderstatus <> 'F'"


@R.add("d6_s8_insert_if_absent", f"""WITH i AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE {INCOMING} GROUP BY 1)
SELECT o_custkey, o_orderkey FROM i WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE {STORED})""")
def insert_if_absent(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return merge.insert_if_absent(rows.where(STORED), rows.where(INCOMING), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@R.add("d7_last_import_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_import_wins(spark, d):
    return merge.pick(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", F.col("event_id"))


@R.add("d8_first_comment_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_comment_wins(spark, d):
    return merge.pick(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"), first=True)


@R.add("d10_most_confident", best("(classifier <> 'baseline_keyword') DESC, confidence DESC NULLS LAST, id ASC", "article_id, id, classifier, confidence"))
def most_confident(spark, d):
    return merge.most_confident_classification(label_rows(spark, d)).select("article_id", "id", "classifier", "confidence")


@R.add(
    "j1_merged_corpus",
    f"""{ROWS}, a AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS source FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'),
cl AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY (classifier <> 'baseline_keyword') DESC, classified_at DESC NULLS LAST, id) AS rn FROM r),
se AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY (method = 'roberta_news_v2') DESC, id DESC) AS rn FROM r),
nw AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY id DESC) AS rn FROM r),
co AS (SELECT o_custkey AS article_id, count(*) FILTER (l_returnflag='A') AS positive, count(*) FILTER (l_returnflag='N') AS neutral, count(*) FILTER (l_returnflag='R') AS negative FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1)
SELECT a.id, a.title, a.source, cl.stakeholder_category AS stakeholder, cl.classifier AS source_type, nw.stakeholder_category AS stable_topic_id, nw.stakeholder_category AS topic, se.sentiment, nw.sentiment AS stance, co.positive, co.neutral, co.negative
FROM a LEFT JOIN cl ON cl.article_id = a.id AND cl.rn = 1 LEFT JOIN se ON se.article_id = a.id AND se.rn = 1 LEFT JOIN nw ON nw.article_id = a.id AND nw.rn = 1 LEFT JOIN co ON co.article_id = a.id""",
)
def merged_corpus(spark, d):
    rows = label_rows(spark, d).withColumn("source_type", F.col("classifier"))
    articles = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("published_date"), F.lit("").alias("clean_content"),
        (F.col("c_acctbal") > 0).alias("llm_relevant"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("success").alias("processing_status"),
    )
    names = F.create_map(*[F.lit(x) for x in ("A", "positive", "N", "neutral", "R", "negative")])
    lines = table(spark, d, "lineitem").select("l_orderkey", names[F.col("l_returnflag")].alias("sentiment"), F.when(F.col("l_linestatus") == "F", merge.COMMENT_METHOD).otherwise("other").alias("method"))
    comments = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("article_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    topics = rows.select("id", "article_id", F.col("stakeholder_category").alias("stable_topic_id"), F.col("stakeholder_category").alias("topic"))
    merged = merge.merged_corpus(articles, rows, topics, rows, rows.select("id", "article_id", F.col("sentiment").alias("stance")), comments)
    return merged.select("id", "title", "source", "stakeholder", "source_type", "stable_topic_id", "topic", "sentiment", "stance", *[F.col(f"comment_sentiment.{s}").alias(s) for s in merge.SENTIMENTS])


@R.add("j2_rows_of_a_run", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def rows_of_a_run(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@R.add("j3_s10_not_yet_labelled", """SELECT DISTINCT o_custkey AS article_id, o_orderpriority AS method FROM orders i WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderstatus = 'F' AND t.o_custkey = i.o_custkey AND t.o_orderpriority = i.o_orderpriority)""")
def not_yet_labelled(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), F.col("o_orderpriority").alias("method"), "o_orderstatus")
    return merge.append_missing(rows.where(STORED), rows.where(INCOMING).select("article_id", "method").distinct())


@R.add("j4_not_found", "SELECT DISTINCT user_id::VARCHAR AS source_id, 'not_found' AS reason FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def not_found(spark, d):
    return monitor.missing_ids(table(spark, d, "events").select(F.col("user_id").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@R.add("j5_orphans", "SELECT count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS orphans FROM (SELECT l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS k FROM lineitem)")
def orphans(spark, d):
    parents = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("k"))
    marked = table(spark, d, "lineitem").select("l_suppkey").join(parents, "l_suppkey", "left")
    return marked.agg(F.count_if(F.col("k").isNotNull()).cast("long").alias("kept"), F.count_if(F.col("k").isNull()).cast("long").alias("orphans"))


@R.add("j8_comment_titles", "SELECT l_orderkey, l_linenumber, p_name AS article_title FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def comment_titles(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("article_title"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(titles, "l_partkey", "left").drop("l_partkey")


@R.add("j10_topic_catalog", "SELECT s_suppkey AS doc_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE n_nationkey::VARCHAR END AS stable_topic_id, CASE WHEN s_acctbal < 0 OR n_name IS NULL THEN 'Unassigned' ELSE n_name END AS topic FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def topic_catalog(spark, d):
    from presswork.operators import topics

    assigned = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_acctbal") < 0, topics.OUTLIER).otherwise(F.col("s_nationkey")).alias("topic_id"))
    catalog = table(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_nationkey").cast("string").alias("stable_topic_id"), F.col("n_name").alias("label"))
    return topics.with_catalog(assigned, catalog).select("doc_id", "stable_topic_id", "topic")


@R.add("j12_u2_unknown_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def unknown_ids(spark, d):
    return monitor.unexpected_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")))


@R.add("s9_upsert", f"""WITH n AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders WHERE {INCOMING} GROUP BY 1, 2), t AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders WHERE {STORED} GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = t.o_custkey AND n.o_orderpriority = t.o_orderpriority)""")
def upsert(spark, d):
    rows, key = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderpriority"]
    target = merge.pick(rows.where(STORED).drop("o_orderstatus"), key, F.col("o_orderkey"))
    return merge.upsert(target, rows.where(INCOMING).drop("o_orderstatus"), key, "o_orderkey")


KEPT = f"""WITH t AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders WHERE {STORED} GROUP BY 1, 2), n AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, min(o_orderkey) AS lowest FROM orders WHERE {INCOMING} GROUP BY 1, 2)"""


def _written(spark, d, write):
    """A table written by key from the stored rows, then twice with the incoming ones, as read again."""
    rows, path = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus"), scratch(spark, "keyed")
    stored = keyed.KeyedTable(spark, path, ["o_custkey", "o_orderpriority"], parts=8)
    stored.upsert(rows.where(STORED).drop("o_orderstatus"), "o_orderkey")
    for _ in range(2):
        write(stored, rows.where(INCOMING).drop("o_orderstatus"))
    out = settle(stored.read(), "written")
    discard(spark, path)
    return out


@R.add("s9_persisted_upsert", f"{KEPT} SELECT o_custkey, o_orderpriority, o_orderkey FROM n UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = t.o_custkey AND n.o_orderpriority = t.o_orderpriority)")
def persisted_upsert(spark, d):
    """An upsert that rewrites the touched partitions of a stored table, and is repeated."""
    return _written(spark, d, lambda t, rows: t.upsert(rows, "o_orderkey"))


@R.add("s10_persisted_append", f"{KEPT} SELECT * FROM t UNION ALL SELECT o_custkey, o_orderpriority, lowest FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE n.o_custkey = t.o_custkey AND n.o_orderpriority = t.o_orderpriority)")
def persisted_append(spark, d):
    """Only missing keys are added to a stored table, and a repeated write adds none."""
    return _written(spark, d, lambda t, rows: t.append_missing(rows, "o_orderkey"))


@R.add("j4_not_found_among_some", "SELECT DISTINCT user_id::VARCHAR AS source_id, 'not_found' AS reason FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_found_among_some(spark, d):
    read = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return monitor.missing_ids(table(spark, d, "events").select(F.col("user_id").alias("id")), read)


@R.add("s11_first_assignment_tally", f"""WITH i AS (SELECT DISTINCT o_custkey FROM orders WHERE {INCOMING}), t AS (SELECT DISTINCT o_custkey FROM orders WHERE {STORED})
SELECT count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM t)) AS inserted, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM t)) AS preserved FROM i""")
def first_assignment_tally(spark, d):
    rows = table(spark, d, "orders")
    return merge.tally(rows.where(STORED), rows.where(INCOMING), "o_custkey")


@R.add("s12_write_once", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END, o_totalprice > 100000) AS is_relevant FROM orders")
def write_once(spark, d):
    current = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return table(spark, d, "orders").select("o_orderkey", merge.write_once(current, F.col("o_totalprice") > 100000).alias("is_relevant"))


@R.add("u1_union_of_sources", "SELECT c_name AS name, 'customer' AS origin FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier UNION ALL SELECT p_name, 'part' FROM part")
def union_of_sources(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("name"), F.lit(t).alias("origin"))
    return one("customer", "c_name").unionByName(one("supplier", "s_name")).unionByName(one("part", "p_name"))


@R.add("u3_distinct_ids", "SELECT DISTINCT l_orderkey AS id FROM lineitem")
def distinct_ids(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
