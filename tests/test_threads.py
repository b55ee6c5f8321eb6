"""Threads of any depth and shape, in a fixed number of jobs."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.sources import threads

VALUES = st.recursive(st.text(max_size=6), lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1, " "]))
def test_parser(value, indent):
    assert threads.parse_json(json.dumps(value, indent=indent)) == value
    assert threads.parse_json(json.dumps(value, ensure_ascii=False)) == value


@pytest.mark.parametrize("bad", ["[", "]", "[}", '{"a": [}', "[] []"])
def test_unmatched(bad):
    with pytest.raises(ValueError):
        threads.parse_json(bad)
    assert threads._replies(bad, "p") == []


def nested(depth, seed):
    rng = random.Random(seed)
    n, rows = 0, []

    def one(above):
        nonlocal n
        n += 1
        c = {"id": n, "body": f'<p>say "{n}"</p>', "status": rng.choice(["visible", "blocked"]), "numRecommends": n, "userProfile": {"userId": f"u{n}"}, "isoDateTime": "2026-01-01T00:00:00Z"}
        if c["status"] == "visible":
            rows.append((str(n), above))
        return c, str(n) if c["status"] == "visible" else above

    top, above = one(None)
    at = top
    for _ in range(depth):
        kids, nexts = [], []
        for _ in range(rng.choice([1, 2])):
            c, a = one(above)
            kids.append(c)
            nexts.append((c, a))
        at["responses"] = kids
        at, above = nexts[-1]
    return top, rows


def written(top):
    """JSON text of a thread too deep for the library's writer."""
    chain, at = [], top
    while at:
        kids = at.pop("responses", [])
        chain.append((at, kids[:-1], bool(kids)))
        at = kids[-1] if kids else None
    text = ""
    for own, before, more in reversed(chain):
        inner = f'"responses": [{"".join(json.dumps(b) + ", " for b in before)}{text}]' if more else '"responses": []'
        text = json.dumps(own)[:-1] + ", " + inner + "}"
    return f"[{text}]"


def test_a_thousand_levels_in_a_fixed_number_of_jobs(spark):
    def jobs(depth):
        top, rows = nested(depth, depth)
        df = spark.createDataFrame([(7, written(top))], "article_id long, comments string")
        group = f"depth{depth}"
        spark.sparkContext.setJobGroup(group, group)
        got = threads.flatten_threads(df).collect()
        spark.sparkContext.setJobGroup("", "")
        assert sorted((r["comment_id"], r["parent_comment_id"]) for r in got) == sorted(rows, key=lambda r: r[0])
        assert all(r["body_text"] == f'say "{r["comment_id"]}"' and r["recommendation_count"] == int(r["comment_id"]) for r in got)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(1000) == jobs(2)
