"""Topics: assignment by a fixed model, discovery by clustering, keywords by class-based TF-IDF."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from presswork.operators.components import components
from presswork.operators.nearest import DECIMALS, Points, search, unit
from presswork.operators.search import numbered
from presswork.session import settle

OUTLIER = -1
MIN_TOPIC_SIZE = 10
#: Topics of a model that travel to the vectors at once.
MODEL_BLOCK = 4096


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector of each label, by position (two-phase sums, no group is collected)."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    ordered = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))  # as long as one vector
    return ordered.select(F.col(label).alias("topic_id"), F.transform("p", lambda s: s["v"]).alias("centroid"))


def assign(vectors: DataFrame, model: DataFrame, threshold: float = 0.0, id_col: str = "vec_id", vector: str = "embedding", counted: bool = False) -> DataFrame:
    """The nearest topic by cosine (6 decimals), or OUTLIER below the threshold; never trains.

    model: one row per topic (topic_id, centroid). It is the stated query set and
    travels to the vectors in blocks of at most MODEL_BLOCK topics; ties go to the
    lower topic id. Topics lie in groups round pivots, and groups that cannot hold a
    nearer one are passed over (``nearest``); ``counted`` adds ``compared``, the
    topics and pivots that a row was held against. Rows stay where they lie.
    Vectors without a direction (NULL, empty, all 0, NULL or non-finite components,
    or another size than the model's) are OUTLIER with a NULL similarity; such
    centroids are never nearest. An empty model leaves only outliers.
    """
    size, count = model.agg(F.max(F.size("centroid")), F.count("*")).first()
    size, blocks = max(size or 0, 0), max(1, -(-count // MODEL_BLOCK))
    placed = model.select(F.col("topic_id").cast("long").alias("topic_id"), F.col("centroid").cast("array<double>").alias("centroid"))
    schema = StructType([vectors.schema[id_col], StructField(vector, ArrayType(DoubleType()))]).add("similarity", "double").add("topic_id", "long").add("compared", "long")
    out = vectors.select(id_col, F.col(vector).cast("array<double>").alias(vector), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("topic_id"), F.lit(0).cast("long").alias("compared"))
    for i in range(blocks):
        block = placed.where(F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == i).toArrow()  # a block
        ids, centroids = block["topic_id"].to_numpy(), unit(block["centroid"].combine_chunks(), size)

        def run(batches, ids=ids, centroids=centroids):
            return search(batches, Points(ids, centroids), size)

        out = out.mapInArrow(run, schema)
    topic = F.when(F.col("similarity") >= threshold, F.col("topic_id")).otherwise(OUTLIER).cast("int")
    return out.select(id_col, topic.alias("topic_id"), F.round("similarity", DECIMALS).alias("similarity"), *(["compared"] if counted else []))


def _cells(points: DataFrame, width: float, dims: int) -> DataFrame:
    """The grid cell of each point, as its whole coordinates."""
    return points.withColumn("cell", F.transform("point", lambda x: F.floor(x / width).cast("int")))


def _grown(counts: DataFrame, dims: int, dense: int) -> DataFrame:
    """(cell, topic): dense cells, joined where they touch; a topic is the least key of its cells."""
    cells = settle(counts.where(F.col("n") >= dense).select("cell", F.xxhash64("cell").alias("k")), "cells")
    steps = F.lit([list(s) for s in itertools.product((-1, 0, 1), repeat=dims) if s > (0,) * dims])  # one of two opposite steps
    beside = cells.select(F.col("k").alias("a"), F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda x, d: x + d))).alias("cell"))
    links = beside.join(cells, "cell").select("a", F.col("k").alias("b"))
    joined = components(links).select(F.col("node").alias("k"), "component")
    return cells.join(joined, "k", "left").select("cell", F.coalesce("component", "k").alias("topic"))


def discover_dense(vectors: DataFrame, min_size: int = MIN_TOPIC_SIZE, dims: int = 3, levels: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Topics as dense regions of reduced vectors; their number is found, not given. Returns id and ``topic_id`` (0 is the largest).

    Unit vectors are reduced to ``dims`` principal components. A grid is laid over
    them; cells with several rows are dense, and dense cells that touch are one
    region. Of grids from coarse to fine (the spread over 2, 4, 8 ...) the one with
    the most regions of ``min_size`` rows counts, of equals the one that leaves
    fewest rows out. Rows outside such regions are OUTLIER. Only counts of cells
    are shuffled for the choice. Fewer than ten rows are refused.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if vectors.limit(10).count() < 10:
        raise ValueError("topic discovery needs at least 10 documents")
    v = F.transform(vector, lambda x: x.cast("double"))
    unit = F.transform(v, lambda x: x / F.greatest(F.sqrt(_product(v, v)), F.lit(1e-12)))
    rows = vectors.select(id_col, array_to_vector(unit).alias("features"))
    reduced = PCA(k=dims, inputCol="features", outputCol="reduced").fit(rows).transform(rows)
    points = settle(reduced.select(id_col, vector_to_array("reduced").alias("point")), "points")
    spread = points.select(F.explode("point").alias("x")).agg(F.stddev_pop("x")).first()[0] or 1.0
    dense, best = max(2, min_size // 3), None
    for level in range(1, levels + 1):
        width = 4 * spread / (1 << level)
        counts = settle(_cells(points, width, dims).groupBy("cell").agg(F.count("*").alias("n")), "counts")
        grown = settle(_grown(counts, dims, dense), "grown")
        regions = counts.join(grown, "cell").groupBy("topic").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size)
        found, inside = regions.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if best is None or (found, inside) > best[:2]:
            best = (found, inside, width, grown, regions)
    _, _, width, grown, regions = best
    numbered = numbered_by_size(settle(regions, "regions"))
    topic = grown.join(numbered, "topic").select("cell", "topic_id")
    return _cells(points, width, dims).join(topic, "cell", "left").select(id_col, F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"))


def numbered_by_size(regions: DataFrame) -> DataFrame:
    """(topic, topic_id): numbers from 0 in descending order of size."""
    return numbered(regions, F.desc("n"), F.asc("topic")).select("topic", (F.col("position") - 1).cast("int").alias("topic_id"))


def discover(vectors: DataFrame, k: int, min_size: int = MIN_TOPIC_SIZE, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters by distributed k-means; clusters smaller than ``min_size`` become OUTLIER. Fewer than ten rows are refused."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if rows.limit(10).count() < 10:
        raise ValueError("topic discovery needs at least 10 documents")
    found = KMeans(k=k, seed=seed).fit(rows).transform(rows).select(id_col, F.col("prediction").alias("c"))
    sizes = found.groupBy("c").agg(F.count("*").alias("n"))  # k rows
    return found.join(F.broadcast(sizes), "c").select(id_col, F.when(F.col("n") < min_size, OUTLIER).otherwise(F.col("c")).alias("topic_id"))


def with_catalog(assigned: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stable id and label of each cluster id; outliers and unknown clusters are 'Unassigned' with a NULL id."""
    return assigned.join(catalog, "topic_id", "left").select(*assigned.columns, "stable_topic_id", F.coalesce("label", F.lit("Unassigned")).alias("topic"))


def keywords(docs: DataFrame, stop_words: DataFrame, topic: str = "topic_id", text: str = "text", top: int = 10, min_length: int = 2) -> DataFrame:
    """The ``top`` terms of each topic by class-based TF-IDF, tf(t, c) * log(1 + A / f(t)), and joined by '; '.

    A is the mean number of words of a topic. Returns (topic, term, weight, place).
    """
    terms = docs.select(topic, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).where(F.length("term") >= min_length).join(stop_words, "term", "left_anti")
    tf = terms.groupBy(topic, "term").agg(F.count("*").alias("tf"))
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.count_distinct(topic)).alias("a"))
    weighted = tf.join(f, "term").crossJoin(F.broadcast(mean)).select(topic, "term", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 6).alias("weight"))
    ranked = weighted.withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("weight"), F.asc("term"))))
    return ranked.where(F.col("place") <= top)


def joined_keywords(ranked: DataFrame, topic: str = "topic_id") -> DataFrame:
    """One row per topic: its terms in weight order, joined by '; '."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    return ranked.groupBy(topic).agg(F.array_join(F.transform(ordered, lambda s: s["term"]), "; ").alias("topic_keywords"))


def model_summary(rows: DataFrame) -> DataFrame:
    """Loaded, eligible, duplicates removed, analysed, assigned, unassigned, from flags on each row."""
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    eligible, first, topic = F.col("eligible"), F.col("first_of_hash"), F.col("topic_id")
    analysed = eligible & first
    return rows.agg(F.count("*").alias("loaded"), n(eligible, "eligible"), n(eligible & ~first, "duplicates_removed"), n(analysed, "analysed"), n(analysed & (topic >= 0), "assigned"), n(analysed & (topic < 0), "unassigned"))
