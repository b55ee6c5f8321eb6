"""Merkle manifest of a table: a root over all rows, and for each row the proof that it is one of them.

Leaves are hashed by built-in functions and numbered inside their group by
range. A group's tree is cut into superblocks of 2**LEVELS nodes. Going up,
each superblock is reduced to one node, and these are the leaves of the next
tier, until a group has one node, its subroot; the subroots are the leaves of
one more tree. Going down, each tier's nodes are cogrouped by superblock with
the outer nodes that their proofs need, and one call finishes the reduction
inside the superblock, joins inner and outer proof, and folds what is claimed.
A superblock has at most 2**(LEVELS + 1) narrow rows, however large a group is;
small groups that lie side by side share one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators.search import numbered
from presswork.session import settle, tidy

#: Levels of the tree in a superblock.
LEVELS = 12
BLOCK = 1 << LEVELS

NODES = "tree long, size long, pos long, node string"
OUTER = "tree long, path string, subroot string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """SHA-256 (hex) of values that are each written as ``length:value`` (UTF-8 bytes), or ``-`` for NULL, one after the other."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _up(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def _height(size: int) -> int:
    """Levels above the nodes of a superblock, in a tree that has ``size`` nodes in this tier."""
    return min(LEVELS, (int(size) - 1).bit_length())


def _keyed(nodes: DataFrame) -> DataFrame:
    """With the key of the superblock: a stretch of a large tree, or the small trees that begin in a stretch of all rows."""
    at = F.when(F.col("size") <= BLOCK, F.col("tree") - F.col("tree") % BLOCK).otherwise(F.col("tree") + F.col("pos") - F.col("pos") % BLOCK)
    return nodes.withColumns({"small": F.col("size") <= BLOCK, "at": at})


def _reduced(block: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (tree, size), part in block.sort_values(["tree", "pos"]).groupby(["tree", "size"]):
        nodes = part["node"].tolist()
        for _ in range(_height(size)):
            nodes = _up(nodes)
        out.append((tree, -(-size // BLOCK), part["pos"].iat[0] // BLOCK, nodes[0]))
    return pd.DataFrame(out, columns=["tree", "size", "pos", "node"])


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, those that their superblocks reduce to, and so on until every tree has one node."""
    out = [nodes]
    while not (rest := out[-1].where("size > 1")).isEmpty():
        out.append(settle(_keyed(rest).groupBy("small", "at").applyInPandas(_reduced, NODES), "tier"))
    return out


def steps(path: str) -> Iterator[tuple[str, str]]:
    """A proof's steps from the leaf on: ("L" or "R", sibling), or (".", "") where a node is alone in its run."""
    for step in re.findall(r"\.|[LR][0-9a-f]{64}", path):
        yield step[0], step[1:]


def fold(node: str, path: str) -> str:
    """The root that a node and its siblings give."""
    for side, sibling in steps(path):
        node = digest(sibling + node if side == "L" else node + sibling)
    return node


def _inner(nodes: list[str], height: int) -> list[str]:
    """The path of every node to the top of its superblock."""
    paths, level = [[] for _ in nodes], nodes
    for h in range(height):
        for i, p in enumerate(paths):
            j = (i >> h) ^ 1
            p.append(("R" if j & 1 else "L") + level[j] if j < len(level) else ".")
        level = _up(level)
    return ["".join(p) for p in paths]


def _proved(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Rows of a superblock with their whole paths and, where there is a claim, the root it folds to."""
    above = {t: (p, s) for t, p, s in zip(outer["outer_tree"], outer["outer_path"], outer["outer_subroot"], strict=True)}
    block = block.sort_values(["tree", "pos"]).reset_index(drop=True)
    paths: list[str] = []
    for (_, size), part in block.groupby(["tree", "size"]):
        paths += _inner(part["node"].tolist(), _height(size))
    whole = [p + above[t][0] for p, t in zip(paths, block["tree"], strict=True)]
    block["path"], block["subroot"] = whole, [above[t][1] for t in block["tree"]]
    if "claim" in block:
        block["folded"] = [fold(c, p) for c, p in zip(block["claim"], whole, strict=True)]
    return block


def _prover(names: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda block, outer: _proved(block, outer)[names]


def _down(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first tier's nodes with the path of each to the root, given the paths of the trees' single nodes (tree, path, subroot)."""
    above = None
    for i in range(len(tiers) - 1, -1, -1):
        tier = _keyed(tiers[i])
        outer = tier.where("size = 1").join(tops, "tree").select("small", "at", "tree", "path", "subroot")
        if above is not None:  # a node above stands for one superblock here
            under = tiers[i].where("size > 1").groupBy("tree").agg(F.max("size").alias("size"))
            sized = above.select("tree", (F.col("pos") * BLOCK).alias("pos"), "path", "subroot").join(under, "tree")
            outer = outer.unionByName(_keyed(sized).select("small", "at", "tree", "path", "subroot"))
        kept = tiers[i].columns
        names = [*kept, "path", "subroot", *(["folded"] if "claim" in kept else [])]
        schema = ", ".join(f"`{c}` {tiers[i].schema[c].dataType.simpleString() if c in kept else 'string'}" for c in names)

        outer = outer.select(*[F.col(c).alias(f"outer_{c}") for c in outer.columns])
        above = tier.groupBy("small", "at").cogroup(outer.groupBy("outer_small", "outer_at")).applyInPandas(_prover(names), schema)
    return above


@tidy("manifest")
def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """A Merkle tree over all rows: id, ``leaf``, ``subroot``, ``root``, ``proof``, ``claim``, ``folded_root`` and ``verified`` of each.

    The leaves of a group (by ``group_col``) ascend by id; every two neighbours
    of a level, or a last single one, become the SHA-256 of their hex digests.
    The groups' subroots, ordered by group (NULL first, by bytes), are joined in
    the same way to the root. ``proof`` has a step for each level up to the root:
    L or R and the sibling, or a dot where there is none. ``claimed`` gives
    other values for some of the columns, as someone may present the row;
    ``folded_root`` is what the claimed leaf and the proof come to, and
    ``verified`` says whether that is the root.

    NULLs, empty and long texts are hashed as they are; rows without id come
    first in their group. Repeated rows are leaves of their own: rows with equal
    ids ascend by leaf, and equal leaves may stand for each other. Only the named
    columns are read. An empty table gives no rows.
    """
    values = {c: F.col(c) for c in columns}
    told = values | dict(claimed or {})
    rows = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf(list(values.values())).alias("node"), leaf(list(told.values())).alias("claim"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows, "leaves")
    placed = settle(numbered(rows, F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node"), F.col("row")), "placed")
    groups = settle(placed.groupBy("group").agg((F.min("position") - 1).alias("tree"), F.count("*").alias("size")), "groups")
    nodes = placed.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
    nodes = settle(nodes.select("tree", "size", (F.col("position") - 1 - F.col("tree")).alias("pos"), "node", "claim", F.col("id").cast("string").alias("id")), "nodes")
    tiers = _tiers(nodes)
    subroots = tiers[0].where("size = 1").select("tree", "node")
    for tier in tiers[1:]:
        subroots = subroots.unionByName(tier.where("size = 1").select("tree", "node"))
    subroots = settle(numbered(subroots, F.col("tree")), "subroots")
    n = subroots.count()
    joined = _tiers(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), (F.col("position") - 1).alias("pos"), "node", F.col("tree").alias("of")))
    root = (joined[-1].where("size = 1").select("node").first() or [None])[0]  # one digest
    start = docs.sparkSession.createDataFrame([(0, "", root)], OUTER)
    tops = settle(_down(joined, start).select(F.col("of").alias("tree"), "path", F.col("node").alias("subroot")), "tops")
    return _down(tiers, tops).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.col("path").alias("proof"), "claim", F.col("folded").alias("folded_root"),
        (F.col("folded") == F.lit(root)).alias("verified"),
    )


def proof_digest(proof: str | Column = "proof") -> Column:
    """SHA-256 (hex) of a proof's siblings, one after the other from the leaf on."""
    c = F.col(proof) if isinstance(proof, str) else proof
    return F.sha2(F.translate(c, "LR.", ""), 256)


def tampered(id_col: str = "doc_id", count_col: str = "n_chars") -> dict[str, Column]:
    """Claims to test a manifest with: one character more where 7 divides the crc32 of the id as text."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 0, F.lit(False))
    return {count_col: F.when(hit, F.col(count_col).cast("decimal(38,0)") + 1).otherwise(F.col(count_col).cast("decimal(38,0)"))}


def manifest_sql() -> str:
    """The same rows in DuckDB SQL, level by level: crc32 by its table, inner and outer trees, and a walk up from every claimed leaf."""
    return """WITH RECURSIVE
bits(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
crcs(id, rest, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 4294967295::UBIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT s.id, s.rest[2:], xor(s.c >> 8, b.c) FROM crcs s JOIN (SELECT i, c FROM bits WHERE k = 8) b ON b.i = xor(s.c, ascii(s.rest)) & 255 WHERE s.rest <> ''
),
told AS (
  SELECT d.doc_id, d.lang, d.source, d.text, d.n_chars, d.n_chars::HUGEINT + CASE WHEN xor(c.c, 4294967295::UBIGINT) % 7 = 0 THEN 1 ELSE 0 END AS claimed
  FROM documents d LEFT JOIN crcs c ON c.id = d.doc_id AND c.rest = ''
),
written AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen(claimed::VARCHAR) || ':' || claimed, '-') AS m, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM told
),
leaves AS (SELECT doc_id, lang, sha256(head || n || tail) AS leaf, sha256(head || m || tail) AS claim FROM written),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM leaves),
up(lang, h, size, pos, node) AS (
  SELECT lang, 0, size, pos, leaf FROM placed
  UNION ALL
  SELECT lang, h + 1, (size + 1) // 2, pos // 2, node FROM (
    SELECT lang, h, size, pos, sha256(node || coalesce(lead(node) OVER (PARTITION BY lang ORDER BY pos), '')) AS node FROM up WHERE size > 1
  ) WHERE pos % 2 = 0
),
inner_nodes AS MATERIALIZED (SELECT * FROM up),
subroots AS MATERIALIZED (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM inner_nodes WHERE size = 1),
top(h, size, pos, node) AS (
  SELECT 0, size, pos, node FROM subroots
  UNION ALL
  SELECT h + 1, (size + 1) // 2, pos // 2, node FROM (
    SELECT h, size, pos, sha256(node || coalesce(lead(node) OVER (ORDER BY pos), '')) AS node FROM top WHERE size > 1
  ) WHERE pos % 2 = 0
),
outer_nodes AS MATERIALIZED (SELECT * FROM top),
walk(doc_id, leaf, lang, part, h, pos, size, node, sibs) AS (
  SELECT doc_id, leaf, lang, 0, 0, pos, size, claim, '' FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang,
    CASE WHEN w.size = 1 THEN 1 ELSE w.part END,
    CASE WHEN w.size = 1 THEN 0 ELSE w.h + 1 END,
    CASE WHEN w.size = 1 THEN r.pos ELSE w.pos // 2 END,
    CASE WHEN w.size = 1 THEN r.size ELSE (w.size + 1) // 2 END,
    CASE WHEN w.size = 1 THEN w.node WHEN w.pos % 2 = 0 THEN sha256(w.node || coalesce(n.node, o.node, '')) ELSE sha256(coalesce(n.node, o.node) || w.node) END,
    CASE WHEN w.size = 1 THEN w.sibs ELSE w.sibs || coalesce(n.node, o.node, '') END
  FROM walk w
  LEFT JOIN inner_nodes n ON w.part = 0 AND n.lang IS NOT DISTINCT FROM w.lang AND n.h = w.h AND n.pos = xor(w.pos, 1) AND w.size > 1
  LEFT JOIN outer_nodes o ON w.part = 1 AND o.h = w.h AND o.pos = xor(w.pos, 1) AND w.size > 1
  LEFT JOIN subroots r ON w.part = 0 AND w.size = 1 AND r.lang IS NOT DISTINCT FROM w.lang
  WHERE w.part = 0 OR w.size > 1
)
SELECT w.doc_id, w.leaf, r.node AS subroot, t.node AS root, sha256(w.sibs) AS proof_sha256, w.node AS folded_root, w.node = t.node AS verified
FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang CROSS JOIN (SELECT node FROM outer_nodes WHERE size = 1) t
WHERE w.part = 1 AND w.size = 1"""
