"""Queries for evaluation, topics, labelling and run monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import density, embed, evaluate, labelling, monitor, search, topics
from presswork.plans.merge import ROWS, label_rows
from presswork.plans.registry import Registry
from presswork.session import settle, table

R = Registry()
PAIRS = "(SELECT x.stakeholder_category AS label_a, y.stakeholder_category AS label_b, count(*) AS n FROM r x JOIN r y ON x.article_id = y.article_id AND x.classifier = 'model' AND y.classifier = 'baseline_keyword' GROUP BY 1, 2)"


@R.add("j6_a12_agreement_matrix", f"{ROWS} SELECT * FROM {PAIRS}")
def agreement_matrix(spark, d):
    return evaluate.agreement(label_rows(spark, d), "model", "baseline_keyword")


STATUS_PAIRS = "(SELECT count(*) AS n, sum((x.sentiment = y.sentiment)::INT) AS same FROM r x JOIN r y ON x.article_id = y.article_id AND x.method = 'roberta_news_v2' AND y.method = 'vader')"


@R.add("a12_agreement_rate", f"{ROWS} SELECT n AS compared, round(same / n::DOUBLE, 6) AS rate FROM {STATUS_PAIRS}")
def agreement_rate(spark, d):
    return evaluate.agreement_rate(evaluate.agreement(label_rows(spark, d), "roberta_news_v2", "vader", kind="method", label="sentiment"))


NAMES = ("low", "high")
LABELLED = "p AS (SELECT doc_id, CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS human, CASE toxic WHEN 1 THEN 'low' ELSE 'high' END AS model FROM labels)"
MATRIX = f"WITH {LABELLED}, m AS (SELECT h.human, o.model, (SELECT count(*) FROM p WHERE p.human = h.human AND p.model = o.model) AS n FROM (VALUES ('low'), ('high')) h(human), (VALUES ('low'), ('high')) o(model))"


def label_pairs(spark, d):
    """Quality as a person's label, and a model that calls toxic documents low."""
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("human"), F.when(F.col("toxic") == 1, "low").otherwise("high").alias("model"))


@R.add("a13_confusion_matrix", f"{MATRIX} SELECT * FROM m")
def confusion_matrix(spark, d):
    return evaluate.confusion(label_pairs(spark, d), NAMES)


@R.add(
    "a14_a15_accuracy_and_kappa",
    f"""{MATRIX}, s AS (SELECT sum(n) AS n, sum(n) FILTER (human = model) AS same FROM m), e AS (SELECT sum(h.c * o.c) AS ch FROM (SELECT human, sum(n) AS c FROM m GROUP BY 1) h JOIN (SELECT model, sum(n) AS c FROM m GROUP BY 1) o ON h.human = o.model)
SELECT n::BIGINT AS compared, round(same / n::DOUBLE, 6) AS accuracy, round((same / n::DOUBLE - ch / (n::DOUBLE * n)) / (1 - ch / (n::DOUBLE * n)), 6) AS kappa, false AS kappa_undefined FROM s, e""",
)
def accuracy_and_kappa(spark, d):
    return evaluate.kappa(confusion_matrix(spark, d))


JUDGED = """h AS (SELECT user_id::VARCHAR AS article_id, event_id AS line, CASE event_type WHEN 'view' THEN '' ELSE event_type END AS human FROM events),
f AS (SELECT article_id, min(line) AS first FROM h GROUP BY 1),
m AS (SELECT o_custkey::VARCHAR AS article_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'purchase' ELSE 'other' END, o_orderkey) AS model FROM orders GROUP BY 1),
j AS (SELECT h.article_id, h.line, h.human, CASE WHEN m.model IN ('click', 'purchase') THEN m.model END AS model,
  CASE WHEN h.line > f.first THEN 'duplicate' WHEN h.human = '' THEN 'blank' WHEN h.human NOT IN ('click', 'purchase') THEN 'unknown' WHEN m.model IS NULL OR m.model NOT IN ('click', 'purchase') THEN 'no_model_label' ELSE 'compared' END AS outcome
  FROM h JOIN f USING (article_id) LEFT JOIN m USING (article_id))"""


def judged_rows(spark, d):
    from presswork.operators.merge import pick

    human = table(spark, d, "events").select(F.col("user_id").alias("article_id"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("human_label"), F.col("event_id").alias("line"))
    model = pick(table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "click").when(F.col("o_orderstatus") == "O", "purchase").otherwise("other").alias("model_label")), "article_id", F.col("o_orderkey"))
    return evaluate.judged(human, model, ("click", "purchase"))


@R.add("j7_d9_judged_labels", f"WITH {JUDGED} SELECT * FROM j")
def judged_labels(spark, d):
    return judged_rows(spark, d)


@R.add("a14_outcome_counts", f"""WITH {JUDGED} SELECT {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ('compared', 'blank', 'unknown', 'no_model_label', 'duplicate'))}, array_to_string(list_sort(list(DISTINCT human) FILTER (outcome = 'unknown')), ',') AS unknown_labels FROM j""")
def outcome_counts(spark, d):
    return evaluate.outcome_counts(judged_rows(spark, d)).withColumn("unknown_labels", F.nullif(F.array_join("unknown_labels", ","), F.lit("")))


TAGS = """WITH c AS (SELECT unnest(list_filter([CASE WHEN length(trim(text)) < 15 THEN 'junk:too_short' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+') THEN 'email' END, CASE WHEN contains(text, 'License') THEN 'licence' END, 'total'], lambda x: x IS NOT NULL)) AS category FROM documents),
g AS (SELECT category, count(*) AS n FROM c GROUP BY 1) SELECT category, n, round(n * 100 / (SELECT n FROM g WHERE category = 'total')::DOUBLE, 2) AS percent FROM g"""


@R.add("a17_tag_report", TAGS)
def tag_report(spark, d):
    t = F.col("text")
    return evaluate.tag_counts(table(spark, d, "documents"), {"junk:too_short": F.length(F.trim(t)) < 15, "email": t.rlike(text.PII[0][1]), "licence": t.contains("License")})


@R.add("a18_w3_samples", """WITH k AS (SELECT source AS category, doc_id AS id, replace(substr(text, 1, 160), chr(10), ' ') AS sample, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) SELECT * FROM k WHERE place <= 3""")
def samples(spark, d):
    return evaluate.tag_samples(table(spark, d, "documents"), F.col("source"), "doc_id", "text").withColumn("place", F.col("place").cast("long"))


FOOTPRINT = "SELECT 'orders' AS table_name, count(*) AS n, max(o_orderkey)::BIGINT AS max_id FROM orders {w} UNION ALL SELECT 'customer', count(*), max(c_custkey)::BIGINT FROM customer UNION ALL SELECT 'events', count(*), max(event_id)::BIGINT FROM events"


def tables(spark, d, where="true"):
    return {"orders": (table(spark, d, "orders").where(where), "o_orderkey"), "customer": (table(spark, d, "customer"), "c_custkey"), "events": (table(spark, d, "events"), "event_id")}


@R.add("a19_footprint", FOOTPRINT.format(w=""))
def footprint(spark, d):
    return monitor.footprint(tables(spark, d))


@R.add("a19_footprint_change", f"""WITH a AS ({FOOTPRINT.format(w='')}), b AS ({FOOTPRINT.format(w="WHERE o_orderdate < DATE '2000-01-01'")}) SELECT table_name, a.n - b.n AS rows_added, a.max_id - b.max_id AS id_growth FROM a JOIN b USING (table_name)""")
def footprint_change(spark, d):
    return monitor.footprint_change(monitor.footprint(tables(spark, d, "o_orderdate < DATE '2000-01-01'")), monitor.footprint(tables(spark, d)))


FUNNEL = "count(*) AS fetched, count(*) FILTER (length(text) > 20) AS stored, count(*) FILTER (length(text) > 20 AND lang = 'en') AS relevant, count(*) FILTER (length(text) > 1000 AND lang = 'en') AS preprocessed"


@R.add("a20_x27_funnel", f"SELECT {FUNNEL}, NULL::VARCHAR AS note FROM documents")
def funnel(spark, d):
    n, en = F.length("text"), F.col("lang") == "en"
    return monitor.funnel_note(monitor.funnel(table(spark, d, "documents"), {"fetched": F.lit(True), "stored": n > 20, "relevant": (n > 20) & en, "preprocessed": (n > 1000) & en}))


@R.add("a21_run_summary", """WITH l AS (SELECT o_custkey AS article_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS label, round(o_totalprice / 600000, 3) AS confidence FROM orders)
SELECT count(*) AS processed, count(label) AS analyzed, count(*) FILTER (label IS NULL) AS failed, count(*) FILTER (confidence < 0.6) AS low_confidence, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) AS skipped_existing FROM l""")
def run_summary(spark, d):
    labelled = table(spark, d, "orders").select(F.col("o_custkey").alias("article_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"), F.round(F.col("o_totalprice") / 600000, 3).alias("confidence"))
    return labelling.run_summary(table(spark, d, "customer").select(F.col("c_custkey").alias("article_id")), table(spark, d, "events").select(F.col("user_id").alias("article_id")), labelled)


SCORED = """WITH s AS (SELECT l_orderkey AS doc_id, round(sum(round(l_discount * 100) * l_quantity) FILTER (l_returnflag='A') / sum(l_quantity) FILTER (l_returnflag='A'), 6) AS positive, round(sum(round(l_discount * 100) * l_quantity) FILTER (l_returnflag='N') / sum(l_quantity) FILTER (l_returnflag='N'), 6) AS neutral, round(sum(round(l_discount * 100) * l_quantity) FILTER (l_returnflag='R') / sum(l_quantity) FILTER (l_returnflag='R'), 6) AS negative FROM lineitem GROUP BY 1),
b AS (SELECT *, greatest(coalesce(positive, -1), coalesce(neutral, -1), coalesce(negative, -1)) AS confidence FROM s)
SELECT doc_id, positive, neutral, negative, CASE WHEN coalesce(positive, -1) = confidence THEN 'positive' WHEN coalesce(neutral, -1) = confidence THEN 'neutral' ELSE 'negative' END AS sentiment, confidence FROM b"""


@R.add("a22_document_scores", SCORED)
def document_scores(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("A", "positive", "N", "neutral", "R", "negative")])
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), names[F.col("l_returnflag")].alias("label"), F.round(F.col("l_discount") * 100).alias("score"), F.col("l_quantity").alias("tokens"))
    return labelling.document_scores(chunks)


WORDS = (("stupid", -2.5), ("idiot", -2.5), ("trash", -2.0), ("the", 0.5), ("of", 0.4))
LEXICON = ", ".join(f"('{w}', {x})" for w, x in WORDS)


@R.add(
    "a23_lexicon_scores",
    f"""WITH lex(word, weight) AS (VALUES {LEXICON}), s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '')) AS sentence FROM documents),
n AS (SELECT *, row_number() OVER () AS k FROM s), w AS (SELECT doc_id, k, unnest(string_split_regex(lower(sentence), '[^\\p{{L}}]+')) AS word FROM n), v AS (SELECT k, sum(weight) AS w FROM w JOIN lex USING (word) GROUP BY k),
c AS (SELECT doc_id, coalesce(w / sqrt(w * w + 15), 0) AS c FROM n LEFT JOIN v USING (k)), m AS (SELECT doc_id, round(avg(c), 6) AS score FROM c GROUP BY 1)
SELECT doc_id, score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment, least(abs(score), 1.0) AS confidence FROM m""",
)
def lexicon_scores(spark, d):
    return labelling.lexicon_scores(table(spark, d, "documents"), spark.createDataFrame(WORDS, "word string, weight double"), text.sentences("text"))


@R.add(
    "a25_topic_summary",
    """WITH k AS (SELECT doc_id, lang = 'en' AS eligible, doc_id = min(doc_id) OVER (PARTITION BY lang = 'en', sha256(text)) AS first, CASE WHEN source IN ('src0', 'src1') THEN -1 ELSE 0 END AS topic_id FROM documents)
SELECT count(*) AS loaded, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND NOT first) AS duplicates_removed, count(*) FILTER (eligible AND first) AS analysed, count(*) FILTER (eligible AND first AND topic_id >= 0) AS assigned, count(*) FILTER (eligible AND first AND topic_id < 0) AS unassigned FROM k""",
)
def topic_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("eligible"), F.sha2("text", 256).alias("h"), F.when(F.col("source").isin("src0", "src1"), -1).otherwise(0).alias("topic_id"))
    firsts = rows.groupBy("eligible", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("f"))
    return topics.model_summary(rows.join(firsts, "doc_id", "left").withColumn("first_of_hash", F.coalesce("f", F.lit(False))))


@R.add("o5_reproducible_sample", "SELECT doc_id, quality, toxic FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def reproducible_sample(spark, d):
    return search.reproducible_sample(table(spark, d, "labels"), "doc_id", 50, 42)


MEANS = "c AS (SELECT label, list(v ORDER BY i) AS centroid FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"


@R.add(
    "m1_topic_assignment",
    f"""WITH {MEANS}, x AS (SELECT vec_id, c.label AS topic, round(list_cosine_similarity(embedding::DOUBLE[], c.centroid), 6) AS similarity FROM embeddings, c),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic) AS rn FROM x) SELECT vec_id, CASE WHEN similarity >= 0.2 THEN topic ELSE -1 END AS topic_id, similarity FROM b WHERE rn = 1""",
)
def topic_assignment(spark, d):
    vectors = table(spark, d, "embeddings")
    return topics.assign(vectors, topics.centroids(vectors), 0.2)


@R.add("m2_topic_discovery")
def topic_discovery(spark, d):
    return topics.discover(table(spark, d, "embeddings"), k=10)


@R.add("m2_dense_topics")
def dense_topics(spark, d):
    """Topics whose number is found."""
    return topics.discover_dense(table(spark, d, "embeddings"))


def _topic_invariants(found, ids, key, min_size):
    """One row about a discovery: rows, ids that are the table's, and whether sizes and numbers are as they should be."""
    sizes = found.where("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("n"))
    order = sizes.agg(F.array_sort(F.collect_list(F.struct("topic_id", "n"))).alias("s"))  # a row for each topic
    numbers, counts = F.transform("s", lambda x: x["topic_id"]), F.transform("s", lambda x: x["n"])
    right = order.select(
        F.coalesce(F.array_min(counts) >= min_size, F.lit(True)).alias("large_enough"), (numbers == F.slice(F.sequence(F.lit(0), F.size("s")), 1, F.size("s"))).alias("numbered"),
        (counts == F.reverse(F.array_sort(counts))).alias("by_size"),
    )
    whole = found.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_ids"))
    return whole.crossJoin(F.broadcast(right))  # one row each


@R.add("m2_density_topics", "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, true AS large_enough, true AS numbered, true AS by_size FROM embeddings")
def density_topics(spark, d):
    """Clusters by stability over a graph of nearest neighbours."""
    vectors = table(spark, d, "embeddings")
    return _topic_invariants(settle(density.discover(vectors), "topics"), vectors, "vec_id", 10)


@R.add("m2_topics_from_texts", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, true AS large_enough, true AS numbered, true AS by_size FROM documents")
def topics_from_texts(spark, d):
    """Discovery from texts alone: hashed TF-IDF, a randomised decomposition, density."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    vectors = settle(embed.fit_apply(docs, stop_words=STOP).select("doc_id", "embedding"), "vectors")
    return _topic_invariants(settle(density.discover(vectors, id_col="doc_id"), "topics"), docs, "doc_id", 10)


STOP = ("the", "and", "der", "die", "que", "les")
TERMS = f"""WITH t AS (SELECT lang, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents), k AS (SELECT * FROM t WHERE length(term) >= 2 AND term NOT IN ({', '.join(f"'{s}'" for s in STOP)})),
tf AS (SELECT lang, term, count(*) AS tf FROM k GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1), w AS (SELECT lang, term, round(tf * ln(1 + (SELECT sum(tf) / count(DISTINCT lang)::DOUBLE FROM tf) / f), 6) AS weight FROM tf JOIN f USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS place FROM w)"""


def ranked_terms(spark, d):
    return topics.keywords(table(spark, d, "documents"), spark.createDataFrame([(s,) for s in STOP], "term string"), topic="lang")


@R.add("m3_topic_keywords", f"{TERMS} SELECT * FROM r WHERE place <= 10")
def topic_keywords(spark, d):
    return ranked_terms(spark, d).withColumn("place", F.col("place").cast("long"))


@R.add("w2_joined_keywords", f"{TERMS} SELECT lang, string_agg(term, '; ' ORDER BY place) AS topic_keywords FROM r WHERE place <= 10 GROUP BY lang")
def joined_keywords(spark, d):
    return topics.joined_keywords(ranked_terms(spark, d), topic="lang")


@R.add("m5_m6_labelling_stage", """SELECT doc_id AS article_id, CASE WHEN length(text) >= 2000 THEN 'positive' WHEN length(text) >= 500 THEN 'neutral' ELSE 'negative' END AS label, round(least(length(text) / 4096.0, 1.0), 3) AS confidence, 'length_rule' AS method, NULL::VARCHAR AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def labelling_stage(spark, d):
    n = F.length("text")
    rule = labelling.ExpressionLabeller("length_rule", F.when(n >= 2000, "positive").when(n >= 500, "neutral").otherwise("negative"), F.least(n / 4096, F.lit(1.0)))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.lit("length_rule").alias("method"))
    return labelling.run_stage(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), done, rule).withColumn("error", F.col("error").cast("string"))


LETTERS = "(1000 * length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))) // length(text)"


def _first_letters(t: str) -> tuple[str, float]:
    share = 1000 * sum(c.isupper() for c in t) // len(t)  # an empty text is an error of its row alone
    return ("positive" if share > 50 else "neutral"), share / 1000


@R.add("m4_row_isolated_labels", f"SELECT doc_id AS id, CASE WHEN text <> '' THEN CASE WHEN {LETTERS} > 50 THEN 'positive' ELSE 'neutral' END END AS label, CASE WHEN text <> '' THEN {LETTERS} / 1000 END AS confidence, CASE WHEN text = '' THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE text END AS text FROM documents)")
def row_isolated_labels(spark, d):
    """French rows have no text here."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "").otherwise(F.col("text")).alias("text"))
    return labelling.RowLabeller("capitals", _first_letters).label(rows)


class VowelLabeller:
    """A labeller of its own kind: all that the contract asks for is a name and ``label``."""

    name = "vowels"

    def label(self, df):
        share = F.regexp_count("text", F.lit("[aeiou]")) / F.greatest(F.length("text"), F.lit(1))
        return df.select("id", F.when(share > 0.3, "positive").otherwise("negative").alias("label"), F.round(share, 3).alias("confidence"), F.lit(None).cast("string").alias("error"))


VOWELS = "(length(text) - length(regexp_replace(text, '[aeiou]', '', 'g'))) / greatest(length(text), 1)::DOUBLE"


@R.add("f1_labeller_contract", f"SELECT doc_id AS article_id, CASE WHEN {VOWELS} > 0.3 THEN 'positive' ELSE 'negative' END AS label, round({VOWELS}, 3) AS confidence, 'vowels' AS method, NULL::VARCHAR AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labeller_contract(spark, d):
    """A stage runs any object with a name and ``label``."""
    done = table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.lit("vowels").alias("method"))
    return labelling.run_stage(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), done, VowelLabeller()).withColumn("error", F.col("error").cast("string"))


@R.add("m5_fallback_labels", f"SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN CASE WHEN n_chars >= 500 THEN 'neutral' END WHEN {LETTERS} > 50 THEN 'positive' ELSE 'neutral' END AS label, CASE WHEN lang = 'fr' THEN CASE WHEN n_chars >= 500 THEN 0.5 END ELSE {LETTERS} / 1000 END AS confidence, CASE WHEN lang <> 'fr' THEN 'capitals' WHEN n_chars >= 500 THEN 'length_rule' END AS method, CASE WHEN lang = 'fr' AND n_chars < 500 THEN 'no label' END AS error FROM documents")
def fallback_labels(spark, d):
    """The first labeller fails on French rows (it gets no text); the rule after it knows long ones only."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", "").otherwise(F.col("text")).alias("text"), "n_chars")
    rule = labelling.ExpressionLabeller("length_rule", F.when(F.col("n_chars") >= 500, "neutral"), F.when(F.col("n_chars") >= 500, F.lit(0.5)))
    return labelling.with_fallback(rows, labelling.RowLabeller("capitals", _first_letters), rule)


# --- runs: a user's events are a run's stages ----------------------------------------------------

STAGES = """WITH s AS (SELECT event_id AS id, user_id AS run_id, CASE event_type WHEN 'view' THEN 'collection' WHEN 'click' THEN 'security' ELSE event_type END AS stage_name, CASE WHEN value < 5 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN value < 10 THEN 'boom' END AS error_detail, value > 90 AS stub, CASE WHEN value > 50 THEN 2 ELSE 1 END AS attempt FROM events)"""


def stages(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "view", "collection").when(F.col("event_type") == "click", "security").otherwise(F.col("event_type")).alias("stage_name"),
        F.when(v < 5, "failed").otherwise("succeeded").alias("status"), F.when(v < 10, "boom").alias("error_detail"), (v > 90).alias("stub"), F.when(v > 50, 2).otherwise(1).alias("attempt"),
    )


@R.add("r1_j9_runs_with_stages", f"{STAGES} SELECT run_id AS id, string_agg(stage_name || ':' || status, ',' ORDER BY s.id) AS stages FROM s WHERE run_id IN (SELECT DISTINCT run_id FROM s ORDER BY run_id DESC LIMIT 20) GROUP BY run_id")
def runs_with_stages(spark, d):
    s = stages(spark, d)
    runs = s.select(F.col("run_id").alias("id")).distinct()
    nested = monitor.runs_with_stages(runs, s, 20)
    return nested.select("id", F.array_join(F.transform("stages", lambda x: F.concat(x["stage_name"], F.lit(":"), x["status"])), ",").alias("stages"))


@R.add("r2_errors", f"{STAGES} SELECT id, run_id, error_detail, CASE status WHEN 'failed' THEN 'failure' ELSE 'recovery' END AS kind FROM s WHERE error_detail IS NOT NULL")
def errors(spark, d):
    return monitor.errors(stages(spark, d)).select("id", "run_id", "error_detail", "kind")


@R.add("r3_stage_flags", f"{STAGES} SELECT run_id, count(*) FILTER (stub AND status = 'succeeded') AS placeholders, count(*) FILTER (attempt > 1) AS retried FROM s GROUP BY 1")
def stage_flags(spark, d):
    return monitor.stage_flags(stages(spark, d))


@R.add("r4_run_outcome", f"""{STAGES}, g AS (SELECT run_id, bool_or(status = 'failed' AND stage_name IN ('collection', 'security')) AS gate, bool_or(status = 'succeeded' AND stage_name NOT IN ('collection', 'security')) AS ok, bool_or(status = 'failed') AS bad FROM s GROUP BY 1)
SELECT run_id, CASE WHEN gate OR NOT ok THEN 'failed' WHEN bad THEN 'completed_with_errors' ELSE 'completed' END AS status FROM g""")
def run_outcome(spark, d):
    return monitor.run_outcome(stages(spark, d))


WINDOWS = "w AS (SELECT event_type AS run_id, min(ts) AS a, max(ts) AS b FROM events WHERE value > 95 GROUP BY 1)"


@R.add("r5_p10_run_coverage", f"""WITH {WINDOWS}, x AS (SELECT user_id, ts, user_id IN (SELECT o_custkey FROM orders) AS has FROM events) SELECT run_id, count(*) AS written, count(*) FILTER (has) AS covered FROM x JOIN w ON ts BETWEEN a AND b GROUP BY 1""")
def run_coverage(spark, d):
    events = table(spark, d, "events")
    runs = events.where("value > 95").groupBy(F.col("event_type").alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    return monitor.coverage(runs, events.select(F.col("user_id").alias("article_id"), F.col("ts").alias("written_at")), table(spark, d, "orders").select(F.col("o_custkey").alias("article_id")))


@R.add("p11_above_high_water", "SELECT event_id FROM events WHERE event_id > (SELECT avg(event_id) FROM events)")
def above_high_water(spark, d):
    events = table(spark, d, "events").select("event_id")
    mark = events.agg(F.avg("event_id").alias("m"))
    return events.crossJoin(F.broadcast(mark)).where("event_id > m").select("event_id")
