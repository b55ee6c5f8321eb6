"""Keyword relevance, stakeholder scoring and source types, driven by dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import quoted

# The vocabulary of the two relevance tests.
AI_PATTERNS = (
    r"\bgenerative ai\b", r"\bgenai\b", r"\bgen ai\b", r"\bchatgpt\b", r"\bgpt-?[345]\b", r"\bgpt\b", r"\blarge language model", r"\bllm\b",
    r"\bllms\b", r"\bclaude\b", r"\bgemini\b", r"\bcopilot\b", r"\bartificial intelligence\b", r"\bmachine learning\b", r"\bai\b",
)
EDUCATION_PATTERNS = (
    r"\bstudent", r"\bteacher", r"\bprofessor", r"\bfaculty", r"\bcurriculum\b", r"\bclassroom", r"\buniversity\b", r"\buniversities\b", r"\bcollege",
    r"\bhigher ed", r"\bk-12\b", r"\bschool", r"\beducation", r"\bacademic\b", r"\bessay\b", r"\bhomework\b", r"\bassignment", r"\bexam\b", r"\bpedagog",
)

# Terms of each stakeholder group; earlier groups win ties.
STAKEHOLDER_TERMS = {
    "students": ("student", "undergrad", "graduate", "learner", "pupil"),
    "educators": ("teacher", "professor", "faculty", "instructor", "educator"),
    "administrators": ("administrator", "dean", "principal", "provost", "university official"),
    "policymakers": ("policy", "lawmaker", "legislator", "regulation", "government"),
    "parents": ("parent", "family", "guardian"),
    "researchers": ("researcher", "study", "academic study", "scholar"),
}

# Parts of host names of each source type; the first that fits wins.
SOURCE_TYPE_DOMAINS = {
    "news_outlet": (
        "edweek.org", "insidehighered.com", "highereddive.com", "hechingerreport.org", "nytimes.com", "washingtonpost.com", "theguardian.com", "politico.com", "edsurge.com",
    ),
    "trade_publication": ("eschoolnews.com", "educationdive.com"),
    "academic": (".edu",),
    "government": (".gov",),
}

MIN_CONFIDENCE = 0.15
UNDETERMINED = "undetermined"


def relevant(title: Column, text: Column, first: Sequence[str] = AI_PATTERNS, second: Sequence[str] = EDUCATION_PATTERNS) -> Column:
    """Some pattern of the first list and some of the second occur in title or text, case ignored."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return both.rlike("(?iU)" + "|".join(first)) & both.rlike("(?iU)" + "|".join(second))


def hits(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of all terms as substrings, each term counted without overlap."""
    out = F.lit(0)
    for t in terms:
        out = out + F.regexp_count(text, F.lit(quoted(t)))
    return out


def stakeholder(title: Column, text: Column, groups: Mapping[str, Sequence[str]] = STAKEHOLDER_TERMS, threshold: float = MIN_CONFIDENCE) -> Column:
    """struct(label, confidence): the group with most hits; the confidence is its share of all hits."""
    lowered = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    counts = {g: hits(lowered, terms) for g, terms in groups.items()}
    scored = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(g).alias("name")) for i, (g, n) in enumerate(counts.items())])
    total = F.aggregate(F.transform(scored, lambda s: s["n"]), F.lit(0), lambda a, b: a + b)
    best = F.array_max(scored)
    confidence = F.when(total > 0, F.round(best["n"] / total, 3)).otherwise(0.0)
    return F.struct(F.when((total == 0) | (best["n"] / total < threshold), UNDETERMINED).otherwise(best["name"]).alias("label"), confidence.alias("confidence"))


def host(url: Column) -> Column:
    """Host with port, lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def source_type(url: Column, domains: Mapping[str, Sequence[str]] = SOURCE_TYPE_DOMAINS, other: str = "blog") -> Column:
    """struct(label, confidence): 0.95 for a known domain, 0.5 for the rest."""
    h, label = host(url), None
    for name, patterns in domains.items():
        for p in patterns:
            label = (F if label is None else label).when(h.contains(p), name)
    return F.struct(F.coalesce(label, F.lit(other)).alias("label"), F.when(label.isNotNull(), 0.95).otherwise(0.5).alias("confidence"))
