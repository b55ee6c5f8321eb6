"""Token counts by a dynamic programme over prefixes.

The last token of a byte-pair encoding of a prefix is the one token that ends
the prefix and goes with the last token of what comes before it. So one pass
over a piece gives the exact token count of each of its prefixes, and with the
counts of the pieces before it, of each prefix of the text. What is stored is a
byte for each character: by how much it changes the count. Truncation and
budget questions are then sums of stored bytes (``tokens_within``,
``longest_fit``), and no text is encoded again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.wordhash import Kept, chunks, hashes_of, spread
from presswork.session import bound_batches

LIMIT = 1024
#: Units of text whose prefix counts a worker keeps (about 30 bytes each), and entries of its dictionaries, before they are emptied.
CACHE, ENTRIES = 2_000_000, 400_000
#: Bytes of kept pieces, about; what one call brings may go beyond it until the next.
PIECE_BYTES = 64 << 20
#: Bytes by whose tokens the search for a last token is narrowed.
SUFFIX = 4
#: Bytes of a unit beyond which its text is not looked up by hash.
LONGEST = 256

#: The byte-level splitting pattern of this family of tokenizers.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts that may be cut before each single space or newline; all others are split by PIECE as a whole.
_UNEVEN = re.compile("[ \n]{3}|[ \n]{2}\\Z|[\t\x0b-\r\x1c-\x1f\x00\x85\xa0\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}]")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by a rule: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_characters()
        as_bytes = lambda t: bytes(byte[c] for c in t)
        self.token = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.reach: dict[bytes, int] = {}  # length of the longest token that ends with these bytes
        for t in self.token:
            self.reach[t[-SUFFIX:]] = max(len(t), self.reach.get(t[-SUFFIX:], 0))
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = self.token[as_bytes(a)], self.token[as_bytes(b)]
            whole = self.token[as_bytes(a) + as_bytes(b)]
            self.rank[x << 20 | y] = r
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (x, y), r
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        self.units = Kept(np.int8, CACHE)
        self.runs = {a + b: self._of(a + b) - self._of(a) for a in " \n" for b in " \n"}

    def _goes_with(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay apart, i.e. no merge ever joins bytes across their border.

        The merges that made a and b are undone from the latest to the
        earliest; at each state the two tokens at the border must not merge
        before the next of them is made.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        left, right, until = a, b, 1 << 40
        good = True
        while True:
            if self.rank.get(left << 20 | right, 1 << 40) < until:
                good = False
                break
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:  # the left token is the later one: before it, its right part stood at the border
                until = made_left
                left = self.parts[left][1]
            else:  # at the same rank the left pair is merged first
                until = made_right + 1
                right = self.parts[right][0]
        if len(self.fits) > ENTRIES:
            self.fits.clear()
        self.fits[key] = good
        return good

    def prefix_counts(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Token count of each prefix (by bytes, from the empty one) of pieces that are each encoded as one.

        Where a piece begins as the one before it, its prefixes are known;
        sorted pieces share most. The list is only good until the next one.
        """
        get, fits, goes, reach = self.token.get, self.fits, self._goes_with, self.reach.get
        lasts, counts, before = [0], [0], b""
        for piece in pieces:
            n, known = len(piece), 0
            for x, y in zip(before, piece):  # noqa: B905
                if x != y:
                    break
                known += 1
            del lasts[known + 1 :], counts[known + 1 :]
            for i in range(known + 1, n + 1):
                for j in range(max(0, i - reach(piece[i - SUFFIX : i], SUFFIX - 1)) if i > SUFFIX else 0, i):
                    t = get(piece[j:i])
                    if t is not None and (not j or (f if (f := fits.get(lasts[j] << 20 | t)) is not None else goes(lasts[j], t))):
                        lasts.append(t)
                        counts.append(counts[j] + 1)
                        break
            before = piece
            yield counts

    def counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of one piece."""
        return next(self.prefix_counts([piece]))

    def _of(self, piece: str) -> int:
        return self.counts(piece.encode())[-1]

    def _learn(self, pieces: set[str]) -> None:
        """Keep the steps of new pieces: by how much each character changes the token count."""
        size = sum(5 * len(p) + 150 for p in pieces)  # of strings of up to four bytes a character, steps and the entry
        if len(self.pieces) + len(pieces) > ENTRIES or self.held + size > PIECE_BYTES:
            self.pieces.clear()
            self.held = 0
        self.held += size
        raw = sorted((p.encode(), p) for p in pieces)
        for (b, piece), counted in zip(raw, self.prefix_counts([b for b, _ in raw]), strict=True):
            if piece[0] == "'" and len(piece) > 2:  # a contraction cut short is a quote and letters
                counted = [0, *(sum(map(self._of, PIECE.findall(piece[:i]))) for i in range(1, len(piece))), counted[-1]]
            elif len(b) != len(piece):
                at = 0
                counted = [0] + [counted[at := at + len(c.encode())] for c in piece]
            self.pieces[piece] = bytes([(y - x) & 255 for x, y in zip(counted, counted[1:])])  # noqa: B905

    def steps_of(self, piece: str) -> bytes:
        """The steps of a piece."""
        if piece not in self.pieces:
            self._learn({piece})
        return self.pieces[piece]

    def _plain(self, text: str) -> int:
        return sum(sum(b - 256 if b > 127 else b for b in self.steps_of(p)) for p in PIECE.findall(text))

    def _stretches(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, special) of the special strings in a text and of what is between them."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def _ordinary(self, text: str) -> bytearray:
        """Steps of a stretch without special strings."""
        out = bytearray()
        run, due = "", 0  # white space just before; by how much the count at the last character is off that of its pieces
        for piece in PIECE.findall(text):
            steps = self.steps_of(piece)
            if due or run and piece[0].isspace():
                own = [b - 256 if b > 127 else b for b in steps]
                # cut after its first character, white space is one piece with the run before
                first = self._of(run + piece[0]) - self._of(run) if run and piece[0].isspace() else own[0]
                gap = own[0] - first
                own[0] = first + due
                if len(own) > 1:
                    own[1] += gap
                    gap = 0
                due, steps = gap, bytes(x & 255 for x in own)
            run = piece if piece.isspace() else ""
            out += steps
        return out

    def _any(self, text: str) -> np.ndarray:
        """Steps of any text. A prefix that ends inside a special string has its first characters as ordinary text."""
        parts, at = [], 0  # where the ordinary text before began
        for a, b, special in self._stretches(text):
            if special:
                before = self._plain(text[at:a])
                counted = [before, *(self._plain(text[at:p]) for p in range(a + 1, b)), before + 1]
                parts.append(np.diff(counted))
                at = b
            else:
                at = a
                parts.append(np.frombuffer(self._ordinary(text[a:b]), dtype=np.int8))
        out = np.concatenate(parts)
        if out.min(initial=0) < -128 or out.max(initial=0) > 127:
            raise ValueError("a character changes the token count by more than a byte holds")
        return out.astype(np.int8)

    def _even(self, text: str) -> bool:
        return not _UNEVEN.search(text) and not any(s in text for s in self.special)

    def _by_units(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Steps of each (even, not empty) text, and the texts with a unit too long to be kept.

        A unit begins where a text does, and at each space or newline.
        """
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        border = (data == 32) | (data == 10)
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        border[first[:-1]] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data))
        with np.errstate(over="ignore"):
            distinct, example, which = np.unique(hashes_of(data, starts, ends), return_index=True, return_inverse=True)

        def new(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = example[at]
            units = [data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            one = [u[0] == " " and u[1:].isalpha() for u in units]  # one piece
            pieces = {u for u, o in zip(units, one, strict=True) if o}.union(*(PIECE.findall(u) for u, o in zip(units, one, strict=True) if not o))
            self._learn(pieces - self.pieces.keys())
            made = [self.pieces[u] if o and u in self.pieces else self._ordinary(u) for u, o in zip(units, one, strict=True)]
            return np.array([len(m) for m in made], dtype=np.int32), np.frombuffer(b"".join(made), dtype=np.int8)

        begin, size = self.units.find(distinct, new)
        size = size[which]
        steps = self.units.values[spread(begin[which], size)]
        chars = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        text_of = np.searchsorted(first, starts, side="right") - 1
        # Two white-space characters in a row, cut after the second, are one piece.
        alone = np.flatnonzero((ends - starts == 1) & ((data[starts] == 32) | (data[starts] == 10)))
        for u in alone.tolist():
            if u + 1 < len(starts) and text_of[u + 1] == text_of[u]:
                at, run = chars[u + 1], self.runs[chr(data[starts[u]]) + chr(data[starts[u + 1]])]
                steps[at + 1] += steps[at] - run
                steps[at] = run
        far = np.unique(text_of[ends - starts > LONGEST]).tolist()
        return np.split(steps, chars[np.searchsorted(starts, first[1:-1])]), far

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """For each text: by how much each of its characters changes the token count of the prefix that it ends."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        even = [i for i, t in enumerate(texts) if t and self._even(t)]
        rest = sorted({i for i, t in enumerate(texts) if t} - set(even))
        raw = [texts[i].encode() for i in even]
        for start, end in chunks(raw):
            found, far = self._by_units(raw[start:end])
            for i, x in zip(even[start:end], found, strict=True):
                out[i] = x
            rest += [even[start + i] for i in far]
        for i in rest:
            out[i] = self._any(texts[i])
        return out

    def total(self, text: str) -> int:
        """Token count of a whole text; special strings in it count as the one token that they are."""
        return int(self.steps([text])[0].sum(dtype=np.int64))

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:p] for p from 0 to len(text).

        A prefix that ends inside a special string has its first characters as
        ordinary text.
        """
        return np.concatenate([[0], np.cumsum(self.steps([text])[0], dtype=np.int32)])

    def longest_prefix(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        return _fit(self.steps([text])[0], limit)


def _fit(steps: np.ndarray, limit: int) -> int:
    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= limit)
    return int(within[-1]) + 1 if len(within) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one for each worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _of_steps(f: Callable[[np.ndarray, int], int]) -> Callable[[Column, Column], Column]:
    def run(steps: pa.Array, number: pa.Array) -> pa.Array:
        return pa.array([None if s is None or n is None else f(np.frombuffer(s, dtype=np.int8), n) for s, n in zip(steps.to_pylist(), number.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "long")


def tokens_within(steps: str | Column, chars: int | Column) -> Column:
    """Token count of the first ``chars`` characters of a text, from its stored steps."""
    return _of_steps(lambda s, n: int(s[: max(0, n)].sum(dtype=np.int64)))(F.col(steps) if isinstance(steps, str) else steps, F.lit(chars).cast("long"))


def longest_fit(steps: str | Column, limit: int | Column) -> Column:
    """Characters of the longest prefix with at most ``limit`` tokens, from the text's stored steps."""
    return _of_steps(_fit)(F.col(steps) if isinstance(steps, str) else steps, F.lit(limit).cast("long"))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chars`` (characters of the longest prefix within the limit), ``prefix_steps`` of every row.

    Tokens are those of the byte-level BPE file at ``path``, without added
    tokens. ``prefix_steps`` has a signed byte for each character: by how much the
    count of the prefix that ends with it exceeds that of the prefix before; so
    it stores the count of every prefix. With ``prefixes``, ``prefix_tokens`` holds
    these counts themselves. NULL counts as the empty text, with 0
    tokens. Whole texts are counted, however long. Repeated rows are counted each,
    and only the two named columns are read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            steps = c.steps(texts)
            n = [int(s.sum(dtype=np.int64)) for s in steps]
            fit = [len(t) if k <= limit else _fit(s, limit) for t, k, s in zip(texts, n, steps, strict=True)]
            columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64()), pa.array([s.tobytes() for s in steps], pa.binary())]
            names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_steps"]
            if prefixes:
                columns, names = [*columns, pa.array([np.concatenate([[0], np.cumsum(s, dtype=np.int32)]) for s in steps], pa.list_(pa.int32()))], [*names, "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_steps binary" + (", prefix_tokens array<int>" if prefixes else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
