"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Only DataFrame functions are used. One narrow pass gives every text's length
and the hash of its first characters; a length that occurs once, or a (length,
prefix hash) pair that occurs once, settles its text as unique. Full content is
hashed (SHA-256) for the surviving texts alone, and only hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import settle, tidy

#: Characters under the prefix hash.
PREFIX_CHARS = 256
#: A set of surviving (length, prefix hash) pairs of at most so many rows is
#: broadcast (16 bytes a row); a larger one is joined by shuffling narrow rows.
BROADCAST_PAIRS = 1_000_000


@tidy("exact")
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), broadcast_pairs: int = BROADCAST_PAIRS, hash_col: str | None = None) -> DataFrame:
    """Class of equal texts for each document: id, ``keep_id``, ``group_size``, ``kept``, and the ``carry`` columns.

    Texts are equal when identical; a NULL text counts as the empty text, and
    all empty texts are one class. ``keep_id`` is the largest id of the class
    (NULL ids are smaller than all others), ``group_size`` its number of rows.
    Every row is returned, repeated rows and rows without id too; those that
    share the largest id of a class are kept together. Whole texts count, however long. With
    ``hash_col``, a column of the texts' SHA-256 that the caller needs anyway,
    no text is hashed twice. Columns other than those named are not read, so
    clashing names do no harm. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length, prefix = F.octet_length(text), F.xxhash64(F.substring(text, 1, PREFIX_CHARS))
    heads = settle(docs.select(length.alias("len"), prefix.alias("ph")).groupBy("len", "ph").agg(F.count("*").alias("n")), "heads")
    # Level 1: lengths with more than one row. Level 2: of these, pairs with more than one row.
    lengths = heads.groupBy("len").agg(F.sum("n").alias("total")).where("total > 1").select("len")
    pairs = settle(heads.where("n > 1").join(lengths, "len", "left_semi").select("len", "ph", F.lit(True).alias("again")), "pairs")
    # Level 3: the full hash, for survivors only.
    rows = docs.select(F.col(id_col).alias("__id"), length.alias("len"), prefix.alias("ph"), text.alias("__t"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    full, kept_cols = F.sha2(F.col("__t"), 256) if hash_col is None else F.col(f"__c{carry.index(hash_col)}"), ["__id", *[f"__c{i}" for i in range(len(carry))]]
    if pairs.count() <= broadcast_pairs:
        marked = rows.join(F.broadcast(pairs), ["len", "ph"], "left").select(*kept_cols, F.when(F.col("again"), full).alias("full"))
    else:  # the text is hashed before the exchange, so that it need not travel
        marked = rows.select(*kept_cols, "len", "ph", full.alias("full")).join(pairs, ["len", "ph"], "left").select(*kept_cols, F.when(F.col("again"), F.col("full")).alias("full"))
    marked = settle(marked, "marked")
    alone = marked.where("full IS NULL").select(*kept_cols, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    several = marked.where("full IS NOT NULL")
    classes = settle(several.groupBy(F.col("full").alias("of")).agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size")), "classes")
    # A class may hold a third of all rows: both sides are written tables, so that the
    # join reads plain exchanges and adaptive execution can split the class.
    members = several.join(classes, F.col("full") == F.col("of")).select(*kept_cols, "keep_id", "group_size")
    out = alone.unionByName(members)
    return out.select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
    )
