"""Comment threads: nested JSON to flat rows, and comments at the nearest visible ancestor."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from presswork.functions.text import plain_line
from presswork.session import bound_batches, settle

#: Comments that Spark has parsed; replies stay JSON text. Its JSON reader goes down to 500 levels, so deeper threads are given as text.
COMMENTS = "array<struct<id:string,body:string,status:string,isoDateTime:string,numRecommends:int,userProfile:struct<userId:string>,responses:string>>"
JSON_OPTIONS = {"maxNestingDepth": "1000000"}


def read_threads(spark: SparkSession, path: str, article_id: Column) -> DataFrame:
    """Discussion files as (article_id, comments), the latter as the text of the file."""
    return spark.read.text(path, wholetext=True).select(article_id.cast("long").alias("article_id"), F.col("value").alias("comments"))


REPLIES = "array<struct<id:string,body:string,visible:boolean,isoDateTime:string,numRecommends:int,userId:string,parent:string>>"
_TOKEN = re.compile(r'("(?:[^"\\]|\\.)*+")|([{}\[\],:])|([^\s{}\[\],:"]++)', re.S)


class _Literal(str):
    """A number, true, false or null, as written."""


def parse_json(text: str) -> object:
    """The value of a JSON text, however deeply nested, without recursion; literals stay as written. ValueError where brackets do not match."""
    root: list = []
    stack: list = [root]
    keys: list[str | None] = [None]
    for m in _TOKEN.finditer(text):
        string, mark, literal = m.groups()
        if mark in ("}", "]"):
            if len(stack) == 1 or isinstance(stack.pop(), dict) != (mark == "}"):
                raise ValueError("brackets do not match")
            keys.pop()
            continue
        if mark in (",", ":"):
            continue
        top = stack[-1]
        if string is not None:
            value: object = string[1:-1] if "\\" not in string else json.loads(string, strict=False)
            if isinstance(top, dict) and keys[-1] is None:
                keys[-1] = value
                continue
        else:
            value = {} if mark == "{" else [] if mark == "[" else _Literal(literal)
        if isinstance(top, dict):
            top[keys[-1]] = value
            keys[-1] = None
        else:
            top.append(value)
        if mark is not None:
            stack.append(value)
            keys.append(None)
    if len(stack) > 1 or len(root) > 1:
        raise ValueError("brackets do not match")
    return root[0] if root else None


def _replies(text: str | None, parent: str | None) -> list[dict]:
    """All replies below a comment, with the nearest visible comment above each; none where the text is no list."""

    def said(x: object) -> str | None:
        return None if x is None or x == "null" and isinstance(x, _Literal) or isinstance(x, dict | list) else str(x)

    try:
        found = parse_json(text or "")
    except ValueError:
        return []
    if isinstance(found, dict):  # a whole discussion
        found = found["discussion"].get("comments") if isinstance(found.get("discussion"), dict) else None
    out, waiting = [], [(found, parent)]
    while waiting:
        comments, above = waiting.pop()
        for c in comments if isinstance(comments, list) else []:
            if isinstance(c, dict):
                visible, n, profile = said(c.get("status")) == "visible", c.get("numRecommends"), c.get("userProfile")
                number = int(n) if isinstance(n, _Literal) and re.fullmatch(r"-?\d{1,9}", n) else None
                out.append({
                    "id": said(c.get("id")), "body": said(c.get("body")), "visible": visible, "isoDateTime": said(c.get("isoDateTime")), "numRecommends": number,
                    "userId": said(profile.get("userId")) if isinstance(profile, dict) else None, "parent": above,
                })
                waiting.append((c.get("responses"), said(c.get("id")) if visible else above))
    return out


def flatten_threads(threads: DataFrame) -> DataFrame:
    """One row per visible comment of (article_id, comments); comments are JSON text (a list, or a discussion with one) or parsed (COMMENTS).

    Replies to a hidden comment take the nearest visible ancestor as parent.
    A thread's replies are read in one pass over its text, whatever their
    depth, so the number of jobs does not depend on it. The body becomes one
    plain line, the user a hash; of repeated comment ids the one with the
    smallest parent stays. Replies that are no JSON list are left out.
    """
    kind = pa.list_(pa.struct([(n, {"boolean": pa.bool_(), "int": pa.int32()}.get(t, pa.string())) for n, t in (x.split(":") for x in REPLIES[len("array<struct<") : -2].split(","))]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, parents in batches:
            yield pa.array([_replies(t.as_py(), p.as_py()) for t, p in zip(texts, parents, strict=True)], kind)

    bound_batches(threads.sparkSession)
    replies = F.arrow_udf(run, REPLIES)
    if isinstance(threads.schema["comments"].dataType, StringType):
        top = threads.select("article_id", replies(F.col("comments"), F.lit(None).cast("string")).alias("every"))
    else:
        top = threads.select("article_id", F.explode("comments").alias("c"))
        visible = F.coalesce(F.col("c.status") == "visible", F.lit(False))
        own = F.struct(F.col("c.id").alias("id"), F.col("c.body").alias("body"), visible.alias("visible"), F.col("c.isoDateTime").alias("isoDateTime"), F.col("c.numRecommends").alias("numRecommends"), F.col("c.userProfile.userId").alias("userId"), F.lit(None).cast("string").alias("parent"))
        every, fields = F.array(own).cast(REPLIES), top.schema["c"].dataType
        if "responses" in fields.names:
            text = F.col("c.responses") if isinstance(fields["responses"].dataType, StringType) else F.to_json("c.responses")
            every = F.concat(every, replies(text, F.when(visible, F.col("c.id"))))
        top = top.select("article_id", every.alias("every"))
    rows = top.select("article_id", F.explode("every").alias("r")).where("r.visible AND r.id IS NOT NULL")
    out = rows.select(
        F.col("r.id").alias("comment_id"), "article_id", F.col("r.parent").alias("parent_comment_id"), plain_line("r.body").alias("body_text"), F.when(F.length("r.userId") > 0, F.sha2(F.col("r.userId"), 256)).alias("author_hash"),
        F.try_to_timestamp("r.isoDateTime").alias("created_at"), F.coalesce("r.numRecommends", F.lit(0)).alias("recommendation_count"),
    )
    columns = [c for c in out.columns if c != "comment_id"]
    return out.groupBy("comment_id").agg(F.min(F.struct(F.coalesce("parent_comment_id", F.lit("")).alias("o"), *columns)).alias("r")).select("comment_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def visible_parents(edges: DataFrame) -> DataFrame:
    """(id, parent) of visible rows of an edge table (id, parent, visible), hidden ancestors skipped.

    Each round moves every pointer that stands on a hidden row to that row's own
    pointer, doubling the reach, until no visible row's pointer stands on one:
    rounds grow with the logarithm of the longest hidden run. Hidden rows that
    form a ring have no visible ancestor; the parent below them is NULL.
    """
    up = settle(edges.select("id", "parent", F.coalesce("visible", F.lit(False)).alias("visible")), "pointers")
    reach, hidden = 1, up.where("NOT visible").count()
    while True:
        above = up.where("NOT visible").select(F.col("id").alias("pid"), F.col("parent").alias("pparent"))
        if not up.where("visible").join(above, F.col("parent") == F.col("pid"), "left_semi").limit(1).count():
            break
        further = F.col("pparent") if reach <= hidden else F.lit(None)
        up = up.join(above, F.col("parent") == F.col("pid"), "left").select("id", F.when(F.col("pid").isNull(), F.col("parent")).otherwise(further).alias("parent"), "visible")
        up = settle(up, "pointers")
        reach *= 2
    return up.where("visible").select("id", "parent")
