"""From raw documents to token files: five stages, each on all that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import decontaminate, minhash, mixing, token_files, toxicity
from presswork.llm.queries import tokenizer
from presswork.session import table, tidy

#: Ids of duplicates are broadcast up to this number (8 bytes each), and joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Share of the words left before mixing that the mixed sample has in expectation.
MIXED_RATE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays.

    Rows that repeat an id stay or go together; rows without id stay.
    """
    found = minhash.near_duplicates(docs, n=5, percent=80)  # written, and read twice
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["__gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of MIXED_RATE of the words, whose token weights meet the tempered source, language and topic marginals.

    Where a cell has too few words for its target, all of it is taken (``mixing.marginals`` names such targets).
    """
    return mixing.mixed(docs, rate=MIXED_RATE)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """All that is left as token ids in ORC files at ``path`` (or a new folder beside the checkpoints); returns a row per document, read from the files."""
    return token_files.tokenise_to_files(docs, tokenizer("word_bpe_49k.json"), end_id=2, path=path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Near duplicates, edit distances and learned scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``; what each stage returns is written and read again, and deleted after its last reader.

    path: where the token files shall lie, for ``token_files.read_tokens``.

    Every stage takes NULLs in any column, empty and very long texts, repeated
    rows, empty tables and further columns of any name, and returns the columns
    that it was given; the last returns a row of the token files for each document.
    """

    def after(k: int) -> DataFrame:
        name, stage = STAGES[k]
        stage = functools.partial(stage, path=path) if path and k == len(STAGES) - 1 else stage
        return tidy(name)(lambda: stage(spark, after(k - 1) if k else table(spark, sf_dir, "documents"), sf_dir))()

    return after(len(STAGES) - 1)
