"""Topics as clusters of density, over a graph of nearest neighbours.

Equal vectors are one node with a weight. Nodes are sorted by random hyperplanes,
several times with other ones, and cut into windows of a fixed number of
neighbours in that order; within a window all distances are taken. The k
nearest of all windows give a graph whose links weigh the mutual reachability:
the greatest of the distance and of both ends' distances to their k-th
neighbour. Boruvka rounds find its minimum spanning forest. Thresholds on that
forest give nested components at a number of density levels, read off the
rounds, and of nested clusters those with the greatest stability are kept.
No window, level or component is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.search import numbered
from presswork.session import bound_batches, settle, tidy

#: Nodes of a window, orders in which windows are cut, hyperplanes of an order.
WINDOW, ORDERS, PLANES = 1024, 8, 16
#: Density levels.
LEVELS = 12
#: Share of the forest's links that the coarsest level leaves out: what only these reach is an outlier at every level.
LEFT_OUT = 0.05
OUTLIER = -1


def unit_nodes(vectors: DataFrame, vector: str) -> DataFrame:
    """(v, weight, node): the distinct vectors of unit length with the number of rows of each, numbered from 0."""
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(doubles(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def unit(c: str) -> Column:
        length = F.sqrt(F.aggregate(doubles(c), F.lit(0.0), lambda s, x: s + x * x))
        return F.get(F.transform(F.array(length), lambda n: F.transform(doubles(c), lambda x: x / F.greatest(n, F.lit(1e-300)))), F.lit(0))

    distinct = vectors.where(fit).groupBy(F.col(vector).alias("raw")).agg(F.count("*").alias("weight"))
    # any order will do for the numbers
    placed = numbered(distinct.withColumn("h", F.xxhash64("raw")), F.col("h"), F.col("raw"))
    return settle(placed.select("raw", unit("raw").alias("v"), "weight", (F.col("position") - 1).alias("node")), "nodes")


def _ordered(seed: int) -> object:
    """Every node once for each order: the signs towards hyperplanes as a number, and the projection on one more direction."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            column = b.column("v")
            ends = column.offsets.to_numpy()
            flat, size = column.values.to_numpy(), np.diff(ends)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = flat[ends[at][:, None] + np.arange(d)[None, :]]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, ORDERS * (PLANES + 1)))
                sides = (x @ planes[d]).reshape(len(at), ORDERS, PLANES + 1)
                code = ((sides[:, :, :PLANES] > 0) << np.arange(PLANES)[::-1]).sum(axis=2)
                own = b.take(pa.array(at))
                for o in range(ORDERS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), o, np.int32)), pa.array(np.full(len(at), d, np.int32)), pa.array(code[:, o]), pa.array(sides[:, o, PLANES].copy()), own.column("node"), own.column("weight"), own.column("v")],
                        names=["o", "d", "code", "along", "node", "weight", "v"],
                    )

    return work


def _least(far: np.ndarray, n: int) -> np.ndarray:
    """The n least of each row in ascending order, of equal ones the first, as a whole stable sort gives them."""
    if n < 1 or n >= far.shape[1]:
        return np.argsort(far, axis=1, kind="stable")[:, :n]
    bound = np.partition(far, n - 1, axis=1)[:, n - 1 : n]
    picked = far <= bound
    out = np.empty((len(far), n), np.int64)
    tied = picked.sum(axis=1) > n  # equal to the last one
    some = np.nonzero(picked[~tied])[1].reshape(-1, n)  # in the order of columns
    out[~tied] = np.take_along_axis(some, np.argsort(np.take_along_axis(far[~tied], some, axis=1), axis=1, kind="stable"), axis=1)
    out[tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :n]
    return out


def _lists(sizes: np.ndarray, far: np.ndarray, to: np.ndarray, weight: np.ndarray) -> pa.Array:
    inside = pa.StructArray.from_arrays([pa.array(far), pa.array(to), pa.array(weight)], names=["far", "to", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inside)


def _nearest(k: int) -> object:
    """For every node of a window its k nearest others in it."""

    def work(window: pa.Table) -> pa.Table:
        window = window.combine_chunks()
        nodes, weights, lengths = (window.column(c).to_numpy() for c in ("node", "weight", "d"))
        vectors = window.column("v").chunk(0)
        start, flat, out = vectors.offsets.to_numpy()[:-1], vectors.values.to_numpy(), []
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            x, node, weight = flat[start[at][:, None] + np.arange(d)], nodes[at], weights[at]
            far = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
            np.fill_diagonal(far, np.inf)
            n = min(k, len(x) - 1)
            near = _least(far, n)
            out.append(pa.Table.from_arrays([pa.array(node), _lists(np.full(len(x), n), np.take_along_axis(far, near, axis=1).ravel(), node[near].ravel(), weight[near].ravel())], names=["node", "near"]))
        return pa.concat_tables(out)

    return work


def _first(k: int) -> object:
    """The k nearest of a node's lists. A pair may have been met in several windows, with distances that differ in the last bits: the least counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("all")
            row = np.repeat(np.arange(b.num_rows), np.diff(every.offsets.to_numpy()))
            far, to, weight = (every.flatten().field(c).to_numpy() for c in ("far", "to", "weight"))
            order = np.lexsort((far, to, row))
            order = order[np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(to[order], prepend=-1) != 0))]
            order = order[np.lexsort((to[order], far[order], row[order]))]
            begins = np.searchsorted(row[order], np.arange(b.num_rows))
            order = order[np.arange(len(order)) - begins[row[order]] < k]
            yield pa.RecordBatch.from_arrays([b.column("node"), _lists(np.bincount(row[order], minlength=b.num_rows), far[order], to[order], weight[order])], names=["node", "near"])

    return work


def neighbours(nodes: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(node, weight, near): up to k nearest nodes as (far, to, weight), nearest first; exact where all nodes fit into one window."""
    bound_batches(nodes.sparkSession)
    kinds = "o int, d int, code long, along double, node long, weight long, v array<double>"
    dealt = nodes.select("node", "weight", "v").mapInArrow(_ordered(seed), kinds)
    placed = numbered(dealt, F.col("o"), F.col("d"), F.col("code"), F.col("along"), F.col("node"))
    windows = placed.withColumn("w", F.floor((F.col("position") - 1) / WINDOW))
    near = "array<struct<far: double, to: bigint, weight: bigint>>"
    lists = windows.select("o", "w", "d", "node", "weight", "v").groupBy("o", "w").applyInArrow(_nearest(k), f"node long, near {near}")
    merged = lists.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("all"))  # ORDERS lists of at most k
    return settle(merged.mapInArrow(_first(k), f"node long, near {near}").join(nodes.select("node", "weight"), "node"), "near")


def reachability(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w): links between near nodes, by mutual reachability; copies of a vector count as neighbours of it."""
    start = F.struct((F.col("weight") - 1).alias("had"), F.lit(0.0).alias("core"))
    core = F.aggregate("near", start, lambda s, x: F.struct((s["had"] + x["weight"]).alias("had"), F.when(s["had"] >= k, s["core"]).otherwise(x["far"]).alias("core")))["core"]
    cores = settle(near.select("node", core.alias("core")), "cores")
    links = near.select(F.col("node").alias("a"), F.explode("near").alias("x")).select("a", F.col("x.to").alias("b"), F.col("x.far").alias("far"))
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far").groupBy("a", "b").agg(F.min("far").alias("far"))
    links = links.join(cores.select(F.col("node").alias("a"), F.col("core").alias("ca")), "a").join(cores.select(F.col("node").alias("b"), F.col("core").alias("cb")), "b")
    return settle(links.select("a", "b", F.greatest("far", "ca", "cb").alias("w")), "links")


def _roots(least: DataFrame) -> DataFrame:
    """(x, root) where every x points to a y, and only pairs that point at each other close a circle: its lesser end is the root of all that leads there.

    Paths are halved until none is left to shorten.
    """
    ahead = lambda t: t.select(F.col("x").alias("y"), F.col("y").alias("z"))
    turned = F.when((F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y"))
    at = settle(least.join(ahead(least), "y").select("x", turned.alias("y")), "roots")
    while True:
        moved = settle(at.join(ahead(at), "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved")), "roots")
        at = moved.select("x", "y")
        if moved.where("moved").isEmpty():
            return at.withColumnRenamed("y", "root")


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, w) of a minimum spanning forest, by Boruvka's rounds; ties go by the ends, so the forest is unique.

    In each round every component takes its least link to another one, and what
    is joined becomes one component: at least half of those that have a link
    are gone afterwards. Parallel links between components are reduced to the least.
    """
    return _grown(links)[0]


def _grown(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest, and (node, up): round by round the weight of the least link of the node's component, and the component that it became part of."""
    left = links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("link")).where("x <> y")
    left, taken, rounds = settle(left, "left"), [], []
    while not left.isEmpty():
        both = left.union(left.select("y", "x", "link"))
        least = settle(both.groupBy("x").agg(F.min(F.struct("link", "y")).alias("m")).select("x", "m.y", "m.link"), "least")
        taken.append(least.select("link").distinct())
        joined = _roots(least.select("x", "y"))
        rounds.append(least.select("x", F.col("link.w").alias("w")).join(joined, "x"))
        moved = left.join(joined.select("x", F.col("root").alias("cx")), "x").join(joined.select(F.col("x").alias("y"), F.col("root").alias("cy")), "y").where("cx <> cy")
        left = settle(moved.groupBy(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).agg(F.min("link").alias("link")), "left")
    step = F.array(F.struct("w", F.col("root").alias("c")))
    up = links.where("false").select(F.col("a").alias("node"), F.array(F.struct("w", F.col("a").alias("c"))).alias("up"))
    if not taken:
        return links.where("false"), up
    for r in reversed(rounds):  # the last has the fewest components
        above = up.select(F.col("node").alias("root"), F.col("up").alias("above"))
        up = settle(r.join(above, "root", "left").select(F.col("x").alias("node"), F.when(F.col("above").isNull(), step).otherwise(F.concat(step, "above")).alias("up")), "up")
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return settle(out.distinct().select("link.a", "link.b", "link.w"), "forest"), up


def _levels(forest: DataFrame) -> list[float]:
    """Thresholds from fine to coarse, at even shares of the forest's links."""
    shares = [(1 - LEFT_OUT) * (i + 1) / LEVELS for i in range(LEVELS)]
    found = forest.agg(F.percentile_approx("w", shares, 100_000)).first()[0] or []
    return sorted({max(x, 1e-9) for x in found})


def _members(up: DataFrame, nodes: DataFrame, levels: list[float]) -> DataFrame:
    """(level, node, c, weight): the component of every node at every level; c is its least node. Nodes without links at a level are left out there.

    The way up through the rounds has the same greatest link between two nodes
    as the forest, so a node goes up as far as a level's threshold lets it, and
    nodes that stop at the same place are one component.
    """
    start = F.struct(F.lit(None).cast("long").alias("c"), F.lit(True).alias("on"))

    def top(e: Column) -> Column:
        return F.aggregate("up", start, lambda s, x: F.when(s["on"] & (x["w"] <= e), F.struct(x["c"].alias("c"), F.lit(True).alias("on"))).otherwise(F.struct(s["c"].alias("c"), F.lit(False).alias("on"))))["c"]

    tops = F.filter(F.transform(F.lit([float(x) for x in levels]), lambda e, i: F.struct(i.alias("level"), top(e).alias("top"))), lambda s: s["top"].isNotNull())
    inside = settle(up.join(nodes.select("node", "weight"), "node").select("node", "weight", F.explode(tops).alias("s")).select("s.level", "s.top", "node", "weight"), "inside")
    least = inside.groupBy("level", "top").agg(F.min("node").alias("c"))
    return settle(inside.join(least, ["level", "top"]).select("level", "node", "c", "weight"), "members")


def _stable(members: DataFrame, levels: list[float], min_size: int) -> DataFrame:
    """(top, level, c): the clusters that are kept, each by the component that has its members.

    From fine to coarse, a component with one cluster inside goes on with it,
    and one with several, or none, begins a cluster. A cluster's stability is
    the sum over its levels of rows times the fall of density (1 / threshold) to
    the next level; it is kept if that is no less than the sum of the best
    clusters inside. Its members are those at the level where half of the
    stability has been reached from the dense side.
    """
    sized = members.groupBy("level", "c").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_size)
    sized = settle(sized, "sized")
    density = [1 / x for x in levels] + [0.0]
    up = members.select((F.col("level") - 1).alias("level"), F.col("node").alias("c"), F.col("c").alias("above"))  # where a component's least node is one level up
    tree = settle(sized.join(up, ["level", "c"], "left"), "tree")
    done, below = [], None
    kinds = "struct<own: double, inside: double, start: int, parts: array<struct<level: int, c: bigint, part: double>>>"
    for i in range(len(levels)):
        here = tree.where(F.col("level") == i).withColumn("gain", F.col("n") * (density[i] - density[i + 1]))
        part = F.array(F.struct(F.lit(i).alias("level"), F.col("c"), F.col("gain").alias("part")))
        if below is None:
            state = F.struct(F.col("gain").alias("own"), F.lit(0.0).alias("inside"), F.lit(i).alias("start"), part.alias("parts")).cast(kinds)
            rows = here.select("c", "above", state.alias("s"))
        else:
            kids = below.groupBy(F.col("above").alias("c")).agg(F.count("*").alias("kids"), F.sum(F.greatest("s.own", "s.inside")).alias("best"), F.first("s").alias("only"))
            whole = here.join(kids, "c", "left")
            one = F.col("kids") == 1
            state = F.struct(
                F.when(one, F.col("only.own") + F.col("gain")).otherwise(F.col("gain")).alias("own"), F.when(one, F.col("only.inside")).otherwise(F.coalesce("best", F.lit(0.0))).alias("inside"),
                F.when(one, F.col("only.start")).otherwise(i).alias("start"), F.when(one, F.concat("only.parts", part)).otherwise(part).alias("parts"),
            ).cast(kinds)
            rows = whole.select("c", "above", state.alias("s"), "kids")
        below = settle(rows.withColumn("level", F.lit(i)), "level")
        done.append(below.select("level", "c", "above", "s"))
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    every = settle(every, "clusters")
    # The top of a chain: the coarsest level, or a component that is one of several inside the next.
    crowd = every.where("above IS NOT NULL").groupBy("level", "above").agg(F.count("*").alias("crowd"))
    tops = every.join(crowd, ["level", "above"], "left").where(F.col("above").isNull() | (F.col("crowd") > 1) | (F.col("level") == len(levels) - 1))
    good = tops.where(F.col("s.own") >= F.col("s.inside")).select(F.col("level"), "c", "s")
    half = F.aggregate(
        F.col("s.parts"), F.struct(F.lit(0.0).alias("sum"), F.get(F.col("s.parts"), F.lit(0)).alias("at"), F.lit(False).alias("full")),
        lambda a, p: F.struct((a["sum"] + p["part"]).alias("sum"), F.when(a["full"], a["at"]).otherwise(p).alias("at"), (a["full"] | (a["sum"] + p["part"] >= F.col("s.own") / 2)).alias("full")),
    )["at"]
    return settle(good.select(F.col("level").alias("top"), "c", half["level"].alias("level"), half["c"].alias("at")), "good")


def _outermost(good: DataFrame, members: DataFrame) -> DataFrame:
    """(node, cluster) of the kept clusters; of nested ones the outermost counts."""
    tops = good.select(F.col("top").alias("level"), "c", F.concat_ws(":", "top", "c").alias("cluster"), F.col("top"))
    # The least node of a kept cluster's core is in every cluster around it.
    around = good.select(F.col("at").alias("node"), F.concat_ws(":", "top", "c").alias("own"), F.col("top").alias("own_top")).join(members.select("level", "node", "c"), "node").join(tops, ["level", "c"])
    inner = around.where(F.col("top") > F.col("own_top")).select(F.col("own").alias("cluster")).distinct()
    kept = good.withColumn("cluster", F.concat_ws(":", "top", "c")).join(inner, "cluster", "left_anti")
    return members.join(kept.select("level", F.col("at").alias("c"), "cluster"), ["level", "c"]).select("node", "cluster")


@tidy("topics")
def discover(vectors: DataFrame, min_size: int = 10, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Topics by density; their number is found, not given, and they may differ in density. Returns id and ``topic_id`` (0 is the largest).

    Distances are those of unit vectors. A topic has at least ``min_size`` rows.
    Rows in no topic are OUTLIER, as are rows without vector or with a component
    that is NULL or not finite; vectors of other lengths are never neighbours.
    Equal vectors share their topic. Fewer than ten rows with vectors are refused.
    """
    nodes = unit_nodes(vectors, vector)
    if nodes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] < 10:
        raise ValueError("topic discovery needs at least 10 documents")
    forest, up = _grown(reachability(neighbours(nodes, k), k))
    levels = _levels(forest) or [1e-9]
    members = _members(up, nodes, levels)
    # a node without links at a level is a component of its own; copies may be many enough to be a topic
    alone = nodes.where(F.col("weight") >= min_size).select("node", "weight", F.explode(F.lit(list(range(len(levels))))).alias("level"))
    alone = alone.join(members.select("level", "node"), ["level", "node"], "left_anti").select("level", "node", F.col("node").alias("c"), "weight")
    members = settle(members.select("level", "node", "c", "weight").unionByName(alone), "members")
    found = settle(_outermost(_stable(members, levels, min_size), members), "found")
    named = settle(found.join(nodes.select("node", "weight"), "node").groupBy("cluster").agg(F.sum("weight").alias("n")), "named")
    ids = numbered(named, F.desc("n"), F.asc("cluster")).select("cluster", (F.col("position") - 1).cast("int").alias("topic_id"))
    by_vector = nodes.join(found.join(ids, "cluster").select("node", "topic_id"), "node").select("raw", "topic_id")
    return vectors.select(id_col, F.col(vector).alias("raw")).join(by_vector, "raw", "left").select(id_col, F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"))
