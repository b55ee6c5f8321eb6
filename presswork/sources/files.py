"""Delimited files: mixed imports, labelled files, spreadsheet-safe exports, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.functions.text import collapse, lenient_int, parse_utc
from presswork.operators.merge import pick
from presswork.session import settle

IMPORT_COLUMNS = ("type", "id", "post_id", "subreddit", "specific_subreddit", "title", "text", "created_utc", "score", "num_comments", "stakeholder_group")
EXPORT_COLUMNS = ("id", "title", "url", "source", "published_date", "source_type", "stakeholder", ("topic_id", "stable_topic_id"), "topic", "sentiment", "stance")
SAMPLE_CHARS = 600


def read_mixed(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, comments, counts) of a ;-separated import whose ``type`` column tells rows apart.

    Numbers and times are cast leniently. Rows without id are bad; of repeated
    ids the last line wins; comments without their post are orphans and dropped.
    counts: one row with posts, comments, bad, orphans.
    """
    raw = spark.read.csv(path, sep=";", header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in IMPORT_COLUMNS), enforceSchema=False)
    lines = raw.withColumn("line", F.monotonically_increasing_id())  # rises along each file
    named = F.length(F.trim(F.coalesce("id", F.lit("")))) > 0
    rows = lines.where(named).select("type", "id", "post_id", F.coalesce(F.nullif("specific_subreddit", F.lit("")), "subreddit").alias("subreddit"), "title", "text", parse_utc("created_utc").alias("created_utc"), lenient_int("score").alias("score"), lenient_int("num_comments").alias("num_comments"), "stakeholder_group", F.lit(dataset).alias("dataset_source"), "line")
    posts = pick(rows.where("type = 'post'"), "id", F.col("line")).drop("type", "post_id", "line")
    all_comments = pick(rows.where("type = 'comment'"), "id", F.col("line")).drop("type", "title", "num_comments", "line")
    ids = posts.select(F.col("id").alias("post_id"))
    comments = all_comments.join(ids, "post_id", "left_semi")
    orphans = all_comments.join(ids, "post_id", "left_anti").agg(F.count("*").alias("orphans"))
    counts = posts.agg(F.count("*").alias("posts")).crossJoin(comments.agg(F.count("*").alias("comments"))).crossJoin(lines.agg(F.count_if(~named).alias("bad"))).crossJoin(orphans)  # one row each
    return posts, comments, counts


def _cp1252(c: Column) -> Column:
    """Text that was read as ISO-8859-1, as cp1252: the two differ in 27 of the bytes from 0x80 to 0x9F."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return F.translate(c, "".join(a for a, x in pairs if x), "".join(x for _, x in pairs))


def read_labelled(spark: SparkSession, path: str, required: Sequence[str] = ("article_id", "human_stance")) -> DataFrame:
    """Filled-in label files with a ``line`` number that runs from 1 through all files in the order of their names (a row of several lines counts once): ; or , by the header, UTF-8 with or without mark, else cp1252 (plain CSV of a spreadsheet)."""
    head = spark.read.text(path).limit(1).first()
    header = head[0] if head else ""
    valid = spark.read.format("binaryFile").load(path).agg(F.bool_and(F.is_valid_utf8(F.col("content").cast("string")))).first()[0]
    sep = ";" if header.count(";") > header.count(",") else ","
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"', encoding="UTF-8" if valid else "ISO-8859-1")
    plain = [c.lstrip("﻿") for c in rows.columns]
    # a file of quoted cells with line breaks is read by one task, so the numbers grow along it
    rows = rows.select("*", F.col("_metadata.file_path"), F.monotonically_increasing_id()).toDF(*plain, "__file", "__place")
    if not valid:
        rows = rows.select(*[_cp1252(F.col(f"`{c}`")).alias(c) for c in plain], "__file", "__place")
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path} has no {' or '.join(missing)} column")
    rows = settle(rows, "labelled")
    first = rows.groupBy(F.col("__file").alias("__of")).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row for each file
    first = first.select("__of", "__first", before.alias("__before"))
    return rows.join(first, F.col("__file") == F.col("__of")).select(*[f"`{c}`" for c in plain], (F.col("__place") - F.col("__first") + 1 + F.col("__before")).alias("line"))


def safe_cell(value: str | Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(df: DataFrame, columns: Sequence[str | tuple[str, str]] = EXPORT_COLUMNS, snippet: bool = False) -> DataFrame:
    """The fixed columns in order, renamed, with safe text cells; the snippet column only for searches."""
    names = [(c, c) if isinstance(c, str) else c for c in (*columns, *(("snippet",) if snippet else ()))]
    kinds = dict(df.dtypes)
    return df.select(*[(safe_cell(field) if kinds[field] == "string" else F.col(field)).alias(header) for header, field in names])


def write_export(df: DataFrame, path: str, **how) -> None:
    """Spreadsheet-ready CSV: byte-order mark, CRLF, doubled quotes, empty cells for NULL."""
    rows = export_rows(df, **how)
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="", quoteAll=False)


def blind_sample(df: DataFrame, text: str = "clean_content") -> DataFrame:
    """Rows for a person to label: no model label, an empty label column, an excerpt of collapsed text."""
    cell = lambda c: safe_cell(F.coalesce(F.col(c), F.lit("")))
    return df.select(F.col("id").alias("article_id"), cell("title").alias("title"), cell("source").alias("source"), cell("url").alias("url"), safe_cell(F.substring(collapse(F.coalesce(text, F.lit(""))), 1, SAMPLE_CHARS)).alias("excerpt"), F.lit("").alias("human_stance"))


def write_topic_outputs(sizes: DataFrame, assignments: DataFrame, manifest: DataFrame, path: str) -> None:
    """Topic sizes with keywords, assignments and a one-row manifest, side by side."""
    sizes.write.mode("overwrite").csv(f"{path}/topics", header=True)
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def append_snapshot(payload: DataFrame, path: str) -> None:
    """Append rows of a snapshot, kept apart by day."""
    payload.withColumn("day", F.to_date("generated_at")).write.mode("append").partitionBy("day").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot's row; only the newest day is read."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("day")).first()[0]  # from partition names
    return rows.where(F.col("day") == newest).orderBy(F.desc("generated_at"), F.desc("run_id")).limit(1)
