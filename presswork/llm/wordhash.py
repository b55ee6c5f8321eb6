"""Vectorised word hashing: whole batches of texts become arrays of word hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes with A-Z lower-cased. A
word's 64-bit hash is a polynomial of its bytes (from prefix sums modulo 2**64),
mixed afterwards, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

U = np.uint64
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z become a-z; the six white-space bytes become 0x20.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each, kept per worker."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(size - 1, b, U))]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together have about ``size`` bytes."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, first word of each text and the end) of the joined texts."""
    joined = FOLD[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    inside = joined != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return joined, starts, ends, np.searchsorted(starts, at)


def hashes_of(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes."""
    powers, inverse = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=U)
    np.cumsum((joined.astype(U) + U(1)) * powers[: len(joined)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end)."""
    joined, starts, ends, first = words(texts)
    return hashes_of(joined, starts, ends), first


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, hash of every word, first word of each text and the end)."""
    joined, starts, ends, first = words(texts)
    return joined, starts, ends, hashes_of(joined, starts, ends), first


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of stretches of the given sizes, one stretch after the other."""
    total = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Kept:
    """Arrays of values by 64-bit hash, for a worker's cache: hashes in order, and where the values of each lie in one array.

    What is new goes to a small recent part, which is merged into the main
    part when it has grown. Beyond ``most`` entries all are forgotten. Two of a
    million entries have the same hash with probability 3e-8.
    """

    RECENT = 1 << 16

    def __init__(self, kind: type | str, most: int) -> None:
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.values, self.used = np.zeros(0, self.kind), 0
        self.main = self.recent = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def _put(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.values):
            grown = np.zeros(2 * (self.used + len(values)), self.kind)
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)

    def find(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) in ``values`` for sorted distinct hashes; ``make`` gives (sizes, values) of the places that are not kept yet."""
        if len(self.main[0]) + len(self.recent[0]) + len(hashes) > self.most:
            self.clear()
        begin, size = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int32)
        for known, b, n in (self.main, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                begin[hit], size[hit] = b[at[hit]], n[at[hit]]
        new = np.flatnonzero(begin < 0)
        if len(new):
            size[new], values = make(new)
            begin[new] = self.used + np.cumsum(size[new], dtype=np.int64) - size[new]
            self._put(values)
            self.recent = self._merged(self.recent, (hashes[new], begin[new], size[new]))
            if len(self.recent[0]) > self.RECENT:
                self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.recent)
        return begin, size


_STEP = [mix(np.array([i + 1], dtype=U) * U(0xD1B54A32D192ED03))[0] | U(1) for i in range(64)]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words (one shorter run if there are fewer; none without words)."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    total = np.full(len(hashes) - width + 1, width, dtype=U)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * _STEP[i]
    return mix(total)
