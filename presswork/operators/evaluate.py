"""Labels against labels: agreement, confusion matrix, accuracy, Cohen's kappa, report counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.search import first_per_group


def agreement(rows: DataFrame, a: str, b: str, key: str = "article_id", kind: str = "classifier", label: str = "stakeholder_category") -> DataFrame:
    """How often classifier a's label x meets classifier b's label y on the same key."""
    x = rows.where(F.col(kind) == a).select(key, F.col(label).alias("label_a"))
    y = rows.where(F.col(kind) == b).select(key, F.col(label).alias("label_b"))
    return x.join(y, key).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def agreement_rate(matrix: DataFrame) -> DataFrame:
    total = F.sum("n")
    return matrix.agg(F.coalesce(total, F.lit(0)).alias("compared"), F.round(F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)) / total, 6).alias("rate"))


def judged(human: DataFrame, model: DataFrame, labels: Sequence[str], line: str = "line") -> DataFrame:
    """Every human row with its ``outcome``: compared, duplicate, blank, unknown or no_model_label.

    Ids are compared as trimmed strings; only the first row of an id (by
    ``line``) counts, later ones are duplicates whatever they say.
    """
    h = human.select(F.trim(F.col("article_id").cast("string")).alias("article_id"), F.lower(F.trim(F.coalesce("human_label", F.lit("")))).alias("human"), F.col(line).alias("line"))
    first = h.groupBy("article_id").agg(F.min("line").alias("first"))
    m = model.where(F.col("model_label").isin(*labels)).select(F.trim(F.col("article_id").cast("string")).alias("article_id"), F.col("model_label").alias("model"))
    joined = h.join(first, "article_id").join(m, "article_id", "left")
    outcome = (
        F.when(F.col("line") > F.col("first"), "duplicate").when(F.col("human") == "", "blank").when(~F.col("human").isin(*labels), "unknown")
        .when(F.col("model").isNull(), "no_model_label").otherwise("compared")
    )
    return joined.select("article_id", "line", "human", "model", outcome.alias("outcome"))


def confusion(pairs: DataFrame, labels: Sequence[str], human: str = "human", model: str = "model") -> DataFrame:
    """(human, model, n) for all pairs of the domain, 0 where none; the domain is a fixed small list."""
    spark = pairs.sparkSession
    domain = spark.createDataFrame([(a, b) for a in labels for b in labels], "human string, model string")
    counted = pairs.groupBy(F.col(human).cast("string").alias("human"), F.col(model).cast("string").alias("model")).agg(F.count("*").alias("n"))
    return domain.join(counted, ["human", "model"], "left").select("human", "model", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kappa(matrix: DataFrame) -> DataFrame:
    """One row from a confusion matrix: compared, accuracy, kappa, kappa_undefined.

    kappa = (p_o - p_e) / (1 - p_e); where p_e is 1 (both sides used one and
    the same label) it is 1.0 and flagged as undefined; all NULL without pairs.
    """
    rows = matrix.groupBy("human").agg(F.sum("n").alias("h"))
    columns = matrix.groupBy("model").agg(F.sum("n").alias("m"))
    chance = rows.join(columns, F.col("human") == F.col("model")).agg(F.sum(F.col("h") * F.col("m")).alias("chance"))
    seen = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("human") == F.col("model"), F.col("n")).otherwise(0)).alias("same"))
    both = seen.crossJoin(F.broadcast(chance))  # one row each
    p_o, p_e = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    full = F.col("n") > 0
    return both.select(
        F.col("n").alias("compared"), F.when(full, F.round(p_o, 6)).alias("accuracy"),
        F.when(full, F.round(F.when(p_e == 1, 1.0).otherwise((p_o - p_e) / (1 - p_e)), 6)).alias("kappa"), F.when(full, p_e == 1).otherwise(False).alias("kappa_undefined"),
    )


def outcome_counts(rows: DataFrame) -> DataFrame:
    """One row of counts over judged rows, with the unknown labels by value."""
    count = lambda o: F.count_if(F.col("outcome") == o).cast("long").alias(o)
    unknown = F.array_sort(F.collect_set(F.when(F.col("outcome") == "unknown", F.col("human"))))
    return rows.agg(*[count(o) for o in ("compared", "blank", "unknown", "no_model_label", "duplicate")], unknown.alias("unknown_labels"))


def tag_counts(rows: DataFrame, tags: Mapping[str, Column]) -> DataFrame:
    """Count and percent of all rows for each tag; a row can have several."""
    tagged = rows.select(F.array_compact(F.array(*[F.when(c, name) for name, c in tags.items()])).alias("t"))
    counted = tagged.select(F.explode(F.concat("t", F.array(F.lit("total")))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = counted.where("category = 'total'").select(F.col("n").alias("all"))
    return counted.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") * 100 / F.col("all"), 2).alias("percent"))


def tag_samples(rows: DataFrame, category: Column, id_col: str, text_col: str, n: int = 3, chars: int = 160) -> DataFrame:
    """Up to n rows of each category by id, the text cut and on one line."""
    kept = rows.select(category.alias("category"), F.col(id_col).alias("id"), F.replace(F.substring(text_col, 1, chars), F.lit("\n"), F.lit(" ")).alias("sample")).where("category IS NOT NULL")
    return first_per_group(kept, "category", n, F.asc("id"))
