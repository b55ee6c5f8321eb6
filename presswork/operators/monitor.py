"""Runs and stages: lists, outcomes, failures, coverage, table footprints, funnels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.search import recent, running_totals

GATES = ("collection", "security")


def runs_with_stages(runs: DataFrame, stages: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs, each with its stages in order of id (one run has a handful)."""
    latest = recent(runs, "id", limit)
    nested = stages.join(latest.select(F.col("id").alias("run_id")), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", "stage_name", "status"))).alias("stages"))
    return latest.join(nested, latest["id"] == nested["run_id"], "left").drop("run_id")


def run_outcome(stages: DataFrame, gates: tuple[str, ...] = GATES) -> DataFrame:
    """failed if a gate failed or no other stage succeeded, completed_with_errors if any failed, else completed."""
    gate = F.col("stage_name").isin(*gates)
    bad = F.col("status") == "failed"
    seen = stages.groupBy("run_id").agg(F.count_if(gate & bad).alias("g"), F.count_if(~gate & (F.col("status") == "succeeded")).alias("ok"), F.count_if(bad).alias("f"))
    return seen.select("run_id", F.when((F.col("g") > 0) | (F.col("ok") == 0), "failed").when(F.col("f") > 0, "completed_with_errors").otherwise("completed").alias("status"))


def errors(stages: DataFrame) -> DataFrame:
    """Stages with an error text: failures, and recoveries that succeeded later."""
    return stages.where("error_detail IS NOT NULL").withColumn("kind", F.when(F.col("status") == "failed", "failure").otherwise("recovery"))


def stage_flags(stages: DataFrame) -> DataFrame:
    """For each run: placeholders that succeeded, and stages that were retried."""
    return stages.groupBy("run_id").agg(F.count_if(F.col("stub") & (F.col("status") == "succeeded")).cast("long").alias("placeholders"), F.count_if(F.col("attempt") > 1).cast("long").alias("retried"))


def coverage(runs: DataFrame, written: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows written in each run's window (both ends included), and how many of them have a row in another table.

    runs: (run_id, started_at, finished_at). Writes and the two ends of every run
    are sorted by time once, with running totals over the writes; a run's figures
    are the totals at its end less those at its start. So a run costs two rows,
    however long it is and however many writes fall into it or into other runs.
    Runs without writes, or that end before they start, are left out.
    """
    has = labelled.select("article_id").distinct().withColumn("__has", F.lit(1))
    marked = written.join(has, "article_id", "left").where("written_at IS NOT NULL")
    none = F.lit(None)
    # At equal times a start stands before the writes, and an end behind them.
    writes = marked.select(F.col("written_at").alias("at"), F.lit(1).alias("side"), F.xxhash64("article_id").alias("tie"), F.lit(1).alias("n"), F.coalesce("__has", F.lit(0)).alias("covered"), none.cast(runs.schema["run_id"].dataType).alias("run_id"))
    ends = runs.where("started_at <= finished_at").select("run_id", F.explode(F.array(F.struct(F.col("started_at").alias("at"), F.lit(0).alias("side")), F.struct(F.col("finished_at").alias("at"), F.lit(2).alias("side")))).alias("e"))
    ends = ends.select("e.at", "e.side", F.xxhash64("run_id").alias("tie"), F.lit(0).alias("n"), F.lit(0).alias("covered"), "run_id")
    placed = running_totals(writes.unionByName(ends), [F.col("at"), F.col("side"), F.col("tie")], {"n": "n_before", "covered": "covered_before"})
    sign = F.when(F.col("side") == 2, 1).otherwise(-1)
    figures = placed.where("side <> 1").groupBy("run_id").agg(F.sum(sign * F.col("n_before")).alias("written"), F.sum(sign * F.col("covered_before")).alias("covered"))
    return figures.where("written > 0")


def footprint(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, n, max_id) of every table."""
    parts = [df.agg(F.count("*").alias("n"), F.max(key).cast("long").alias("max_id")).select(F.lit(name).alias("table_name"), "n", "max_id") for name, (df, key) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def footprint_change(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("table_name", F.col("n").alias("n0"), F.col("max_id").alias("m0"))
    return after.join(b, "table_name").select("table_name", (F.col("n") - F.col("n0")).alias("rows_added"), (F.col("max_id") - F.col("m0")).alias("id_growth"))


def funnel(rows: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """One row with the count of each step."""
    return rows.agg(*[F.count_if(c).cast("long").alias(name) for name, c in steps.items()])


def funnel_note(counts: DataFrame) -> DataFrame:
    """Why nothing came through, by the first step of fetched, stored, relevant, preprocessed that is 0; NULL if something did."""
    note = (
        F.when(F.col("fetched") == 0, "No source returned anything.").when(F.col("stored") == 0, "Everything fetched was already stored.")
        .when(F.col("relevant") == 0, "Nothing new was relevant.").when(F.col("preprocessed") == 0, "No relevant page could be read.")
    )
    return counts.withColumn("note", note)


def missing_ids(collected: DataFrame, read: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were collected but could not be read back, as quarantine rows."""
    return collected.select(key).distinct().join(read.select(key), key, "left_anti").select(F.col(key).cast("string").alias("source_id"), F.lit("not_found").alias("reason"))


def unexpected_ids(approved: DataFrame, collected: DataFrame, key: str = "id") -> DataFrame:
    """Approved ids that were never collected; must be empty."""
    return approved.select(key).distinct().join(collected.select(key), key, "left_anti")
