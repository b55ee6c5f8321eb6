"""Queries for filters, search and option lists, over ``documents``, ``conversations``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import search
from presswork.plans.registry import Registry
from presswork.session import discard, scratch, settle, table
from presswork.sources import text_index, threads

R = Registry()
WS = "[ \\t\\n\\x0B\\f\\r]+"


def snippet_sql(t: str, q: str) -> str:
    at = f"strpos(lower({t}), '{q}')"
    start, end = f"greatest({at} - 81, 0)", f"least(length({t}), {at} - 1 + {len(q)} + 80)"
    return f"CASE WHEN {at} > 0 THEN (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substr({t}, {start} + 1, {end} - {start}), '{WS}', ' ', 'g')) || (CASE WHEN {end} < length({t}) THEN '…' ELSE '' END) END"


def articles(spark, d):
    """``documents`` as articles: title is the first line's start, a text over 200 characters counts as processed."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("source"), "lang", F.col("text").alias("clean_content"), (F.col("lang") == "en").alias("is_relevant"),
        F.when(F.col("source") != "src0", F.col("lang").isin("en", "fr")).alias("llm_relevant"), F.when(F.length("text") > 200, "success").otherwise("failed").alias("processing_status"),
    )


ARTICLES = "WITH a AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, source, lang, text AS clean_content, lang = 'en' AS is_relevant, CASE WHEN source <> 'src0' THEN lang IN ('en', 'fr') END AS llm_relevant, CASE WHEN length(text) > 200 THEN 'success' ELSE 'failed' END AS processing_status FROM documents)"


@R.add("p1_analysable", f"{ARTICLES} SELECT id, source FROM a WHERE llm_relevant AND processing_status = 'success'")
def analysable(spark, d):
    return search.analysable(articles(spark, d)).select("id", "source")


@R.add("p2_eligible", f"{ARTICLES}, e AS (SELECT id, sha256(clean_content) AS h FROM a WHERE is_relevant AND llm_relevant AND processing_status = 'success' AND trim(coalesce(clean_content, '')) <> '') SELECT min(id) AS id, h AS content_hash FROM e GROUP BY h")
def eligible(spark, d):
    from presswork.operators.merge import unique_by_hash

    rows = search.eligible(articles(spark, d)).select("id", text.content_hash("clean_content").alias("content_hash"))
    return unique_by_hash(rows).select("id", "content_hash")


@R.add("p3_days", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'")
def days(spark, d):
    return table(spark, d, "orders").where(search.in_days("o_orderdate", "1997-03-01", "1997-05-31")).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@R.add("p4_exact_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def exact_filters(spark, d):
    rows = table(spark, d, "orders").withColumn("title", F.lit("")).withColumn("clean_content", F.lit(""))
    return search.apply_filters(rows, {"source_type": "F", "stakeholder": "2-HIGH", "topic": ""}, "o_orderdate", exact={"source_type": "o_orderstatus", "stakeholder": "o_orderpriority", "topic": "o_custkey"}).select("o_orderkey")


Q = "license"


@R.add("p5_x16_keyword_search", f"{ARTICLES} SELECT id, title, {snippet_sql('clean_content', Q)} AS snippet FROM a WHERE contains(lower(clean_content), '{Q}') OR contains(lower(title), '{Q}')")
def keyword_search(spark, d):
    return search.apply_filters(articles(spark, d), {"q": "License"}).select("id", "title", "snippet")


@R.add("p5_indexed_search", f"{ARTICLES} SELECT id, title, {snippet_sql('clean_content', Q)} AS snippet FROM a WHERE contains(lower(clean_content), '{Q}') OR contains(lower(title), '{Q}')")
def indexed_search(spark, d):
    """The same search over a stored table, of which the index leaves some blocks to be read."""
    path = scratch(spark, "index")
    text_index.build(articles(spark, d).select("id", "title", "clean_content"), path, ("title", "clean_content"), "id", block_rows=16, part_blocks=4)
    found = text_index.search(spark, path, "License", ("title", "clean_content"), part_blocks=4)
    out = settle(found.select("id", "title", text.snippet("clean_content", Q).alias("snippet")), "found")
    discard(spark, path)
    return out


COMMENTS = "c AS (SELECT conv_id || ':' || turn AS comment_id, conv_id AS article_id, text AS body_text, turn AS n, role = 'user' AS screened, contains(text, 'http') AS quarantined FROM conversations)"


def comments(spark, d):
    """``conversations`` as comments: user turns are screened, those with links are in quarantine; later turns are newer."""
    return table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("comment_id"), F.col("conv_id").alias("article_id"), F.col("text").alias("body_text"), F.timestamp_seconds(F.col("turn")).alias("created_at"), F.col("turn").alias("recommendation_count"),
        (F.col("role") == "user").alias("screened"), F.col("text").contains("http").alias("quarantined"),
    )


@R.add(
    "p6_o2_comment_search",
    f"""WITH {COMMENTS}, t AS (SELECT doc_id, substr(text, 1, 40) AS title FROM documents), m AS (SELECT comment_id, article_id, title, n, body_text, count(*) OVER () AS total FROM c JOIN t ON article_id = doc_id WHERE screened AND NOT quarantined AND contains(lower(body_text), 'the '))
SELECT comment_id, article_id, title AS article_title, n AS recommendation_count, {snippet_sql('body_text', 'the ')} AS snippet, total FROM m ORDER BY n DESC NULLS LAST, comment_id LIMIT 50""",
)
def comment_search(spark, d):
    return search.search_comments(comments(spark, d), articles(spark, d), "The ").drop("created_at")


@R.add("p7_output_fields", f"{ARTICLES} SELECT id, title, source FROM a")
def output_fields(spark, d):
    rows = articles(spark, d)
    return rows.select(*[c for c in search.ARTICLE_FIELDS if c in rows.columns])


@R.add("p9_unknown_filter_values", "WITH r(field, value) AS (VALUES ('p_brand', 'Brand#99'), ('p_brand', (SELECT min(p_brand) FROM part)), ('nothing', 'x')) SELECT field, value FROM r WHERE field = 'p_brand' AND value NOT IN (SELECT p_brand FROM part)")
def unknown_filter_values(spark, d):
    part = table(spark, d, "part")
    asked = part.agg(F.min("p_brand").alias("b")).select(F.explode(F.array(F.struct(F.lit("p_brand").alias("field"), F.lit("Brand#99").alias("value")), F.struct(F.lit("p_brand").alias("field"), F.col("b").alias("value")), F.struct(F.lit("nothing").alias("field"), F.lit("x").alias("value")))).alias("s")).select("s.*")
    options = part.select(F.lit("p_brand").alias("field"), F.col("p_brand").alias("value")).distinct()
    return search.unknown_values(asked, options)


@R.add("p10_written_between", "SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events WHERE value > 99) AND (SELECT max(ts) FROM events WHERE value > 99) GROUP BY 1")
def written_between(spark, d):
    events = table(spark, d, "events")
    ends = events.where("value > 99").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return events.crossJoin(F.broadcast(ends)).where("ts BETWEEN a AND b").groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("p12_backlog", f"{ARTICLES} SELECT id FROM a WHERE llm_relevant AND processing_status = 'success' ORDER BY id LIMIT 100")
def backlog(spark, d):
    return search.analysable(articles(spark, d)).select("id").orderBy("id").limit(100)


@R.add("p13_comments_to_label", f"WITH {COMMENTS} SELECT comment_id, substr(trim(body_text), 1, 5000) AS body FROM c WHERE screened AND trim(body_text) <> '' AND article_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def comments_to_label(spark, d):
    ready = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("article_id"))
    rows = comments(spark, d).where("screened").where(text.present("body_text")).join(ready, "article_id", "left_semi")
    return rows.select("comment_id", F.substring(F.trim("body_text"), 1, 5000).alias("body")).dropDuplicates(["comment_id"])


@R.add("p14_pending_comments", f"WITH {COMMENTS} SELECT comment_id FROM c WHERE NOT screened ORDER BY comment_id LIMIT 2000")
def pending_comments(spark, d):
    return comments(spark, d).where("NOT screened").select("comment_id").orderBy("comment_id").limit(2000)


@R.add("p15_without_comments", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def without_comments(spark, d):
    have = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").join(have, "doc_id", "left_anti")


@R.add("p16_unreviewed", "SELECT event_id FROM events WHERE value < 10 ORDER BY ts DESC NULLS LAST, event_id LIMIT 50")
def unreviewed(spark, d):
    return table(spark, d, "events").where("value < 10").orderBy(F.desc_nulls_last("ts"), "event_id").limit(50).select("event_id")


@R.add("o1_newest_first", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position FROM orders")
def newest_first(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return search.numbered(rows, *search.newest_first(rows, "o_orderdate", "o_orderkey")).select("o_orderkey", "position")


@R.add("o4_recent_runs", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def recent_runs(spark, d):
    return search.recent(table(spark, d, "events").select("event_id"), "event_id", 500)


@R.add("a10_filter_options", "SELECT DISTINCT 'p_brand' AS field, p_brand AS value FROM part WHERE p_brand <> '' UNION ALL SELECT DISTINCT 'p_type', p_type FROM part WHERE p_type <> ''")
def options(spark, d):
    rows = table(spark, d, "part").withColumn("day", F.lit(None).cast("timestamp"))
    return search.filter_options(rows, ["p_brand", "p_type"], "day").where("value IS NOT NULL")


@R.add("a10_date_options", "SELECT 'date_min' AS field, min(o_orderdate)::DATE::VARCHAR AS value FROM orders UNION ALL SELECT 'date_max', max(o_orderdate)::DATE::VARCHAR FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def date_options(spark, d):
    return search.filter_options(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate")


@R.add("s7_visible_parents", """WITH c AS (SELECT conv_id, turn, role = 'user' AS visible FROM conversations)
SELECT conv_id || ':' || turn AS id, (SELECT conv_id || ':' || max(p.turn) FROM c p WHERE p.conv_id = c.conv_id AND p.visible AND p.turn < c.turn GROUP BY p.conv_id) AS parent FROM c WHERE visible""")
def visible_parents(spark, d):
    """Turns as a reply chain in which only the user's turns are visible."""
    turn = lambda n: F.concat_ws(":", "conv_id", n.cast("string"))
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    rows = table(spark, d, "conversations").withColumn("first", first)
    edges = rows.select(turn(F.col("turn")).alias("id"), F.when(F.col("turn") > F.col("first"), turn(F.col("turn") - 1)).alias("parent"), (F.col("role") == "user").alias("visible"))
    return threads.visible_parents(edges)
