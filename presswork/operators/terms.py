"""Dictionaries as tables: all terms of all groups counted in one pass over the texts.

The dictionary goes to the executors as an automaton that finds every term at
once, so neither the plan nor the work for a text grows with the number of
terms. A dictionary beyond BLOCK_BYTES goes in blocks, one pass a block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.classify import MIN_CONFIDENCE, UNDETERMINED
from presswork.session import bound_batches, settle

#: Bytes of terms that are sent at a time; an automaton takes some ten times as much.
BLOCK_BYTES = 8 << 20

COUNTS = "array<struct<place: int, n: bigint>>"


def dictionary(spark: SparkSession, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """A dictionary table (name, place, term) from lists; ``place`` is the group's rank, earlier groups win ties."""
    return spark.createDataFrame([(g, i, t) for i, (g, terms) in enumerate(groups.items()) for t in terms], "name string, place int, term string")


class Matcher:
    """Finds all terms in one pass. Each term counts without overlapping itself; different terms may overlap."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        import ahocorasick  # needed by this class only

        self.places: list[int] = []
        terms: dict[str, list[int]] = defaultdict(list)
        for place, term in rows:
            if term:
                terms[term].append(len(self.places))
                self.places.append(place)
        self.automaton = ahocorasick.Automaton()
        for term, numbers in terms.items():
            self.automaton.add_word(term, (len(term), numbers))
        if terms:
            self.automaton.make_automaton()

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences by group."""
        out: dict[int, int] = defaultdict(int)
        free: dict[int, int] = {}
        if text and self.places:
            for last, (length, numbers) in self.automaton.iter(text):
                first = last + 1 - length
                if first >= free.get(numbers[0], 0):
                    free[numbers[0]] = last + 1
                    for i in numbers:
                        out[self.places[i]] += 1
        return out


def _block(dictionary: DataFrame, blocks: int, i: int) -> list[tuple[int, str]]:
    rows = dictionary.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).select("place", "term").orderBy("place", "term")
    return [(r["place"], r["term"]) for r in rows.collect()]  # a block


def _counter(spark: SparkSession, rows: list[tuple[int, str]]) -> Callable[[Column], Column]:
    sent = spark.sparkContext.broadcast(rows)  # at most about BLOCK_BYTES
    kind = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(sent.value)
        for b in batches:
            yield pa.array([[{"place": p, "n": n} for p, n in sorted(matcher.counts(t.as_py()).items())] for t in b], kind)

    bound_batches(spark)
    return F.arrow_udf(run, COUNTS)


def count_terms(docs: DataFrame, dictionary: DataFrame, text: Column, name: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``name``: for each group with occurrences, its place and their number (substrings, case as given).

    dictionary: rows (place, term); a term listed several times in a group
    counts so often; NULL and empty terms are nothing. NULL texts have no occurrences.
    """
    terms = dictionary.where("term <> ''").select(F.col("place").cast("int").alias("place"), "term")
    blocks = max(1, -(-(terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) // block_bytes))
    out = docs.withColumn(name, F.array().cast(COUNTS))
    for i in range(blocks):
        out = out.withColumn(name, F.concat(name, _counter(docs.sparkSession, _block(terms, blocks, i))(text)))
        if i + 1 < blocks:  # one automaton at a time in a worker
            out = settle(out, "terms")
    return out


def best_group(docs: DataFrame, dictionary: DataFrame, text: Column, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """``docs`` with ``label`` and ``confidence``: the group with most hits (ties to the earlier one) and its share of all hits, or 'undetermined'."""
    names = dictionary.groupBy("place").agg(F.min("name").alias("name"))
    counted = count_terms(docs, dictionary, text, "__hits")
    # a group's hits may come from several blocks
    summed = F.aggregate(
        F.array_sort("__hits"), F.array().cast(COUNTS),
        lambda s, x: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["place"] == x["place"]), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(x["place"].alias("place"), (F.get(s, F.size(s) - 1)["n"] + x["n"]).alias("n"))))).otherwise(F.concat(s, F.array(x))),
    )
    best = F.array_max(F.transform(summed, lambda s: F.struct(s["n"].alias("n"), (-s["place"]).alias("order"))))
    total = F.aggregate("__hits", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    scored = counted.withColumn("__best", best).withColumn("__total", total).drop("__hits")
    named = scored.join(F.broadcast(names), -F.col("__best.order") == names["place"], "left") if names.count() <= 100_000 else scored.join(names, -F.col("__best.order") == names["place"], "left")
    share = F.col("__best.n") / F.col("__total")
    label = F.when((F.col("__total") == 0) | (share < threshold), UNDETERMINED).otherwise(F.col("name"))
    confidence = F.when(F.col("__total") > 0, F.round(share, 3)).otherwise(0.0)
    return named.select(*docs.columns, label.alias("label"), confidence.alias("confidence"))
