"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

A test item that may differ in k characters is cut into k + 1 pieces; whatever
the k edits are, one piece is untouched. One automaton finds all pieces of all
items in a text in a single pass. The same argument holds for runs of pieces: of
two runs of a and b pieces one has fewer than a, or fewer than b, edits. So some
untouched piece lies in a run of 2 with at most 1 edit, that in a run of 4 with
at most 3, and so on; a hit that fails on the way is given up without loss, and
the others are verified by the edit distance between the item and the
best-matching stretch of the text around the hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.textmap import per_text
from presswork.session import settle, tidy

#: Edits allowed, as a share of the item's characters (rounded down).
ERROR_RATE = 0.1
#: Runs of so many pieces are checked before the whole item.
RUNS = (2, 4)
#: Items are sent to the executors in blocks of about so many bytes at most; a worker's automaton takes some ten times as much.
BLOCK_BYTES = 16 << 20
#: Bit masks of so many items and runs, made when first hit, are kept by a worker before it starts anew.
MASKS = 20_000

MATCHES = "array<struct<item_id: bigint, edits: int, start: int, end: int>>"


def normalise(text: str | None) -> str:
    """Lower case, white space as single spaces, trimmed; '' for NULL."""
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance between a pattern of length m and any stretch of ``text``, end of the first such stretch)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best, end


class Items:
    """Test items ready for search in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in ((i, normalise(t)) for i, t in items) if t]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, t, k) in enumerate(self.items):
            for j in range(k + 1):
                pieces[t[len(t) * j // (k + 1) : len(t) * (j + 1) // (k + 1)]].append((number, j))
        self.kept: dict[tuple[int, int, int], tuple[int, dict[str, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _masks(self, number: int, a: int, b: int) -> tuple[int, dict[str, int]]:
        """Length and bit masks of the characters from a to b of an item (backwards if b < a)."""
        found = self.kept.get((number, a, b))
        if found is None:
            if len(self.kept) >= MASKS:
                self.kept.clear()
            t = self.items[number][1]
            found = self.kept[number, a, b] = (abs(b - a), masks(t[a:b] if a <= b else t[b:a][::-1]))
        return found

    def _in_runs(self, text: str, number: int, j: int, start: int) -> bool:
        """Whether the runs of pieces around piece j have few enough edits where the piece was found."""
        _, t, k = self.items[number]
        pieces = k + 1
        for size in RUNS:
            if size >= pieces:
                break
            first = j - j % size
            last = min(first + size, pieces)
            budget = last - first - 1
            if budget:
                a = len(t) * first // pieces
                m, peq = self._masks(number, a, len(t) * last // pieces)
                at = start + a
                if nearest(peq, m, text[max(0, at - budget) : at + m + budget])[0] > budget:
                    return False
        return True

    def find(self, text: str | None) -> list[dict]:
        """The best match of every item within its budget: item_id, edits, start and end in the normalised text."""
        text, starts = normalise(text), defaultdict(list)
        if not self.items or not text:
            return []
        for last, (length, places) in self.automaton.iter(text):
            for number, j in places:
                _, t, k = self.items[number]
                start = last + 1 - length - len(t) * j // (k + 1)  # of the item, if nothing before the piece is edited
                if self._in_runs(text, number, j, start):
                    starts[number].append(start)
        out = []
        for number in sorted(starts):
            item_id, t, k = self.items[number]
            (m, peq), best = self._masks(number, 0, len(t)), None
            region: list[int] | None = None
            for s in [*sorted(set(starts[number])), None]:
                if region and (s is None or s - k > region[1]):
                    edits, end = nearest(peq, m, text[region[0] : region[1]])
                    if edits <= k and (best is None or edits < best[0]):
                        best = (edits, region[0] + end)
                    region = None
                if s is not None:
                    lo, hi = max(0, s - k), s + m + k
                    region = [lo, hi] if region is None else [region[0], hi]
            if best:
                back = text[max(0, best[1] - m - k) : best[1]][::-1]
                out.append({"item_id": item_id, "edits": best[0], "start": best[1] - _reach(self._masks(number, m, 0)[1], m, back, best[0]), "end": best[1]})
        return out


def _reach(peq: dict[str, int], m: int, text: str, edits: int) -> int:
    """Length of the shortest prefix of ``text`` at the given distance from the whole pattern."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += 1 if up & top else -1 if down & top else 0
        if score == edits:
            return i + 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return len(text)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with text, in blocks of about ``block_bytes``."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL AND trim(t) <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        yield [(r["id"], r["t"]) for r in items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == i).orderBy("id", "t").collect()]


def _matched(docs: DataFrame, items: list[tuple[int, str]], text_col: str, error_rate: float) -> DataFrame:
    """``row`` (a struct of all columns) and ``matches`` of every document against one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)  # at most about a block's bytes
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def make() -> Callable[[list[str | None]], pa.Array]:
        search = Items(sent.value, error_rate)
        return lambda texts: pa.array([search.find(t) for t in texts], kind)

    return docs.select(F.struct("*").alias("row"), per_text(docs.sparkSession, make, MATCHES)(F.col(text_col)).alias("matches"))


@tidy("matches")
def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (document, item) where the document holds the item within its error budget.

    Columns: id, ``item_id``, ``edits``, ``start``, ``end`` (the best stretch,
    in characters of the normalised text; the first of equals). Texts and items
    are compared in lower case with white space as single spaces. NULL or blank
    texts and items match nothing; a repeated document row is reported each time
    it occurs, a repeated item once. An empty table on either side gives no rows.
    Only the named columns are read. Documents are read once for each block of items.
    """
    docs, parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), []
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        found = _matched(docs, items, "text", error_rate).select(F.col("row.id").alias(id_col), F.explode("matches").alias("m")).select(id_col, "m.*")
        parts.append(settle(found, "block"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item within its error budget, with their columns as they were.

    Columns may have any names. Rows are judged by their own text, so repeated
    rows stay or go together; NULL and blank texts hold nothing and stay, as does
    everything if there are no items. Whole texts are searched, however long.
    With several blocks of items, what one block leaves is written before the next.
    """
    for number, items in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        docs = settle(docs, "left") if number else docs
        docs = _matched(docs, items, text_col, error_rate).where(F.size("matches") == 0).select("row.*")
    return docs
