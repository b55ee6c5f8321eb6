"""Personal data by bootstrapped contextual extraction.

Fixed forms (e-mail, IP, card and phone numbers) are the seeds. The one, two or
three words before a seed are its lexical patterns; before anything else that
looks like an identifier (a token with digits or an @) the same words are looked
at. Spark holds the graph of patterns and values, and scores it in rounds: a
pattern by the share of all its occurrences in the corpus that stand before
known values, a value by the share of its occurrences that stand behind good
patterns. Good patterns, and values that mostly stand behind them, discover
identifiers that no fixed form matches. Ordinary words have low shares, since
all occurrences of a pattern count, whatever follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.textmap import per_text
from presswork.llm.wordhash import U, chunks, mix, word_hashes
from presswork.session import bound_batches, settle, tidy

KINDS = ("email", "ip", "card", "phone")
#: Distinct known values that a pattern needs, and the least share of its occurrences that stand before known ones.
SUPPORT, CONFIDENCE = 4, 0.8
#: A value counts as known when this share of its occurrences (weighted by confidence) stands behind good patterns.
KNOWN = 0.5
ROUNDS = 4
#: Pattern keys sent to the executors at a time (8 bytes each); more patterns take further passes.
PATTERNS = 1_000_000
#: Tables of good patterns or known values are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Characters before a span in which its words are looked for; a word that is cut there is no cue.
REACH = 160

SPACE = r"\x20\x09-\x0D"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match begins where a run of digits begins, so that no run is read again from its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token with a digit or @, or groups of digits.
_TOKEN = re.compile(rf"(?<![^{SPACE}])(?:[(+]?[0-9]++(?:[\x20().-]{{1,2}}[0-9]++)++|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)")
_GLUED = re.compile(r"[A-Za-z_]{2,30}[:=]")
_OPEN, _CLOSE = "\"'`([{<«“‘", "\"'`)]}>»”’.,;:!?"

SPANS = "array<struct<start: int, kind: int, end: int>>"
FOUND = f"struct<base: {SPANS}, seen: array<struct<start: int, end: int, kind: int, value: bigint, c1: bigint, c2: bigint, c3: bigint>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one @; what is before it is the run of allowed characters back to the last @ or match."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed forms, sorted; time in proportion to the text."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches outside the fixed forms that look like identifiers: an @ with characters on both sides, five digits, or six characters with a digit."""
    out, k, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if (g := _GLUED.match(text, start, end)) and g.end() < end:
            start = g.end()
        token = text[start:end]
        start, end = end - len(token.lstrip(_OPEN)), start + len(token.rstrip(_CLOSE))
        while k < len(base) and base[k][0] < end:  # furthest end of the fixed forms that begin before this one ends
            reach = max(reach, base[k][2])
            k += 1
        value = text[start:end]
        digits = sum("0" <= c <= "9" for c in value)
        if reach <= start and ("@" in value[1:-1] or digits >= 5 or digits and len(value) >= 6 and not set(value) <= set("0123456789.,-/:%")):
            out.append((start, end))
    return out


def _cues(text: str, start: int) -> list[str]:
    """Up to three words before a place, the nearest first; a word joined to it counts if it has a letter or digit."""
    low = max(0, start - REACH)
    words = re.split(rf"[{SPACE}]+", text[low:start])
    if low:
        words = words[1:]
    if words and not any(c.isalnum() for c in words[-1]):
        words = words[:-1]
    return [w for w in reversed(words) if w][:3]


def patterns(words: np.ndarray) -> list[np.ndarray]:
    """Keys of the one, two and three words that end at each word; the first ones have fewer."""
    with np.errstate(over="ignore"):
        one = words * U(3)
        two = one[1:] + words[:-1] * U(5)
        three = two[1:] + words[:-2] * U(7)
        return [mix(one + U(1)), mix(two + U(2)), mix(three + U(3))]


def _found(texts: list[str | None]) -> pa.Array:
    """Base spans, and every seed and candidate with its value and patterns."""
    rows, cues, values = [], [], []
    for t in texts:
        t = t or ""
        base = base_spans(t)
        seen = [(s, e, kind) for s, kind, e in base] + [(s, e, -1) for s, e in candidates(t, base)]
        rows.append((base, seen))
        for s, e, _ in seen:
            cues.append(_cues(t, s))
            values.append(xxhash.xxh64_intdigest(t[s:e].lower().encode("utf-8", "surrogatepass")))
    words = [w.encode("utf-8", "surrogatepass") for c in cues for w in c]
    hashes = np.concatenate([word_hashes(words[a:b])[0] for a, b in chunks(words)]) if words else np.zeros(0, U)
    keys: list[list[int | None]] = []
    at = 0
    for c in cues:
        own = patterns(hashes[at : at + len(c)][::-1])
        keys.append([int(p[-1].astype(np.int64)) if len(p) and i < len(c) else None for i, p in enumerate(own)])
        at += len(c)
    signed = np.array(values, dtype=U).astype(np.int64).tolist()
    out, n = [], 0
    for base, seen in rows:
        out.append({"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "seen": [
            {"start": s, "end": e, "kind": k, "value": signed[n + i], "c1": keys[n + i][0], "c2": keys[n + i][1], "c3": keys[n + i][2]} for i, (s, e, k) in enumerate(seen)
        ]})
        n += len(seen)
    i32, i64 = pa.int32(), pa.int64()
    span = pa.struct([("start", i32), ("kind", i32), ("end", i32)])
    one = pa.struct([("start", i32), ("end", i32), ("kind", i32), ("value", i64), ("c1", i64), ("c2", i64), ("c3", i64)])
    return pa.array(out, pa.struct([("base", pa.list_(span)), ("seen", pa.list_(one))]))


def _occurrences(docs: DataFrame, text_col: str, wanted: list[int]) -> DataFrame:
    """(pattern, total): how often each wanted pattern occurs in all texts, whatever follows it."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(wanted, dtype=np.int64)))  # at most PATTERNS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        total = np.zeros(len(keys), dtype=np.int64)
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
            for start, end in chunks(raw):
                words, first = word_hashes(raw[start:end])
                text = np.repeat(np.arange(end - start), np.diff(first))
                for i, p in enumerate(patterns(words)):
                    p = p[text[i:] == text[: len(text) - i]].astype(np.int64) if len(text) > i else p[:0].astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
                    total += np.bincount(at[keys[at] == p], minlength=len(keys))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(total[hit])], names=["pattern", "total"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a count, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _levels(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each pattern of each row."""
    return df.select(*keep, F.explode(F.array("c1", "c2", "c3")).alias("pattern")).where("pattern IS NOT NULL")


def _bootstrap(docs: DataFrame, text_col: str, seen: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(good patterns: pattern, kind, confidence; values known by them: value, kind), or None where no pattern is good."""
    types = settle(seen.groupBy("c1", "c2", "c3", "value", "kind").agg(F.count("*").alias("n")), "types")
    edges = settle(_levels(types, "value", "n").groupBy("pattern", "value").agg(F.sum("n").alias("n")), "edges")
    slots = settle(edges.groupBy("pattern").agg(F.sum("n").alias("slot"), F.count("*").alias("values")).where(F.col("values") >= SUPPORT), "slots")
    edges = settle(edges.join(slots.select("pattern"), "pattern", "left_semi"), "edges")
    seeds = settle(types.where("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("score")), "seeds")
    known, totals, good, before = seeds, None, None, None
    for _ in range(ROUNDS):
        hits = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count("*").alias("support"))
        hits = hits.where(F.col("support") >= SUPPORT).join(slots, "pattern").where(F.col("hit") >= CONFIDENCE * F.col("slot"))
        hits = settle(hits, "hits")
        new = settle(hits.select("pattern").distinct() if totals is None else hits.select("pattern").distinct().join(totals, "pattern", "left_anti"), "new")
        for block in range(passes := -(-new.count() // PATTERNS)):
            own = new.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == block)
            counted = settle(_occurrences(docs, text_col, [r["pattern"] for r in own.collect()]), "totals")
            counted = own.join(counted, "pattern", "left").select("pattern", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
            totals = counted if totals is None else totals.unionByName(counted)
        if totals is None:
            return None
        sure = hits.join(totals, "pattern").withColumn("confidence", F.col("hit") / F.greatest("total", "slot")).where(F.col("confidence") >= CONFIDENCE)
        good = settle(sure.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence")), "good")
        state = tuple(good.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)"))).first())
        if state[0] == 0:
            return None
        behind = _levels(types.where("kind < 0"), "value", "n", F.struct("c1", "c2", "c3").alias("cues")).join(_small(good), "pattern")
        behind = behind.groupBy("value", "n", "cues").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence"))
        behind = behind.groupBy("value", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("part"))
        all_of = types.groupBy("value").agg(F.sum("n").alias("all"))
        learned = behind.join(all_of, "value").withColumn("score", F.col("part") / F.col("all")).where(F.col("score") > KNOWN).join(seeds, "value", "left_anti")
        known = settle(seeds.unionByName(learned.select("value", "kind", "score")), "known")
        if state == before:
            break
        before = state
    return good, known.join(seeds, "value", "left_anti").select("value", "kind")


@tidy("pii")
def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row: id, ``base`` and ``spans``, arrays of (start, kind, end) in code points, ends exclusive, sorted by start and kind.

    ``kind`` is a place in KINDS. ``base`` has the fixed forms (leftmost, not
    overlapping within a kind; parts of an IP at most 255, 12 to 19 digits with
    Luhn's check for cards, 9 to 15 digits for phones). ``spans`` has these and
    what the patterns discover outside them: stretches that look like
    identifiers, of the kind of the values that the pattern was learned from.

    Whole texts are read, in time proportional to their length; NULL counts as
    empty. Repeated rows and rows without id are rows of their own, and copies
    of a text add no support to a pattern, as only distinct values count. Only
    the named columns are read. An empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("id"), per_text(docs.sparkSession, lambda: _found, FOUND)(F.col(text_col)).alias("x"), F.monotonically_increasing_id().alias("row"))
    read = settle(read.select("id", "row", "x.base", "x.seen"), "read")
    seen = read.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    learned = _bootstrap(docs, text_col, seen)
    if learned is None:
        return read.select(F.col("id").alias(id_col), "base", F.col("base").alias("spans"))
    good, values = learned
    odd = seen.where("kind < 0").drop("kind")
    by_cue = _levels(odd, "row", "start", "end").join(_small(good), "pattern").select("row", "start", "end", "kind", "confidence")
    by_value = odd.join(_small(values), "value").select("row", "start", "end", "kind", F.lit(0.0).alias("confidence"))
    more = by_cue.unionByName(by_value).groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = more.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    joined = read.join(settle(more, "more"), F.col("row") == F.col("of"), "left")
    return joined.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of fixed forms by kind, ``base_sha256`` of the written fixed forms, and all spans written out."""
    counts = [F.size(F.array_remove(F.transform("base", lambda s: F.when(s["kind"] == i, 1).otherwise(0)), 0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
