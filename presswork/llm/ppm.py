"""Language-model scoring by prediction by partial matching over byte contexts.

The model is the trie of all byte contexts up to ORDER of the training texts,
with symbol exclusion and escapes estimated by method D (half a count of every
distinct symbol goes to the escape): a symbol not seen in a context costs that
context's escape, and the symbols seen there are out of the running in the
shorter ones. A text is coded in its token form (A-Z lower-cased, words parted
by one space, one end symbol), the form that the unigram base also sees.

The trie is never in one place. Documents lie in blocks of bounded bytes; a block
asks for the grams (context and symbol) and words that occur in it, packed as
arrays by bucket. Grams are dealt to buckets by their last context bytes, so that
every longer context of a gram is in its bucket. Counts are summed over slabs of
so many blocks, slabs of slabs and so on, so no task sees all blocks; each
bucket's totals become code lengths, which go back to the blocks slab by slab, in
the order asked. The number of buckets is fixed (distinct grams saturate), so
the packed rows are in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.toxicity import split_key
from presswork.llm.wordhash import FOLD, U, chunks, mix, word_hashes
from presswork.session import bound_batches, settle, tidy

#: Bytes of context.
ORDER = 5
#: Text bytes of a block.
BLOCK_BYTES = 12 << 20
#: Blocks of a slab, and slabs of the next larger one.
SLAB = 256
#: Keys of a block that wait at most before they are merged.
MERGE_AT = 1 << 19
#: Context bytes by which grams are dealt to 2**BITS buckets; shorter contexts come from a table of at most 256**MIDDLE counts.
MIDDLE, BITS = 2, 8
GRAM, WORD, LOW = 0, 1, 2
END = 255  # not a byte of UTF-8: the end of a text, and what stands before it


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of the gram that ends at every symbol to be coded, first key of each text).

    A key has the ORDER bytes before a symbol and the symbol, 8 bits each.
    """
    gap = bytes([END]) * ORDER
    raw = FOLD[np.frombuffer(gap + b"".join(t + gap for t in texts), dtype=np.uint8)]
    space = raw == 32
    edge = np.flatnonzero(np.diff(space, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    keep = ~space
    inner = (raw[starts - 1] != END) & (raw[ends] != END)  # a run of white space between two words
    keep[starts[inner]] = True
    b = raw[keep]
    key = np.zeros(len(b), dtype=U)
    for back in range(ORDER, -1, -1):
        key = (key << U(8)) | np.concatenate([np.full(back, END, dtype=np.uint8), b[: len(b) - back]])
    # coded are the bytes that are kept of each text, and the first END after them
    sizes = np.array([len(t) for t in texts])
    begin = ORDER + np.cumsum(sizes + ORDER) - sizes - ORDER
    kept = np.concatenate([[0], np.cumsum(keep)])
    lengths = kept[begin + sizes] - kept[begin]
    coded = b != END
    coded[ORDER + np.cumsum(lengths) + ORDER * np.arange(len(texts))] = True
    first = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + 1, out=first[1:])
    return key[coded], first


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


_LOW_BITS = U(8 * (ORDER - MIDDLE))


def _turned(key: np.ndarray) -> np.ndarray:
    """Gram keys with the middle context bytes in front: those of a bucket lie close in order."""
    return ((key >> U(8)) & U((1 << 8 * MIDDLE) - 1)) << (_LOW_BITS + U(8)) | (key >> U(8 * MIDDLE + 8)) << U(8) | (key & U(255))


def _turned_back(key: np.ndarray) -> np.ndarray:
    return ((key >> U(8)) & U((1 << 8 * (ORDER - MIDDLE)) - 1)) << U(8 * MIDDLE + 8) | (key >> (_LOW_BITS + U(8))) << U(8) | (key & U(255))


def _bucket(kind: int, keys: np.ndarray) -> np.ndarray:
    """Buckets of turned grams (by their middle context) or of word hashes."""
    return ((mix(keys >> (_LOW_BITS + U(8))) if kind == GRAM else keys) >> U(64 - BITS)).astype(np.int64)


def _wanted(texts: list[bytes], times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For grams and words: the distinct keys of a block, sorted, and their training counts (a text counts ``times``)."""
    found: dict[int, list] = {GRAM: [], WORD: []}
    for start, end in chunks(texts):
        part, weight = texts[start:end], times[start:end]
        keys, first = _grams(part)
        hashes, word = word_hashes(part)
        for kind, k, n in ((GRAM, _turned(keys), np.diff(np.append(first, len(keys)))), (WORD, hashes, np.diff(word))):
            each = np.repeat(weight, n)
            for w in np.unique(weight):
                u, c = np.unique(k[each == w], return_counts=True)
                found[kind].append((u, c * w))
            if sum(len(p[0]) for p in found[kind][1:]) > MERGE_AT:
                found[kind] = [_sum(np.concatenate([p[0] for p in found[kind]]), np.concatenate([p[1] for p in found[kind]]))]
    return {kind: _sum(np.concatenate([np.zeros(0, U), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])) for kind, parts in found.items()}


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: first bytes first, then second bytes, and so on."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, U), dtype=U)


_PACKED = "kind int, slab long, bucket int, block long, keys binary, vals binary"
_NAMES = ["kind", "slab", "bucket", "block", "keys", "vals"]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_NAMES)


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of sorted keys; 0 for keys that are not there."""
    if not len(keys):
        return np.zeros(len(asked), dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


class Level:
    """Counts of all grams with k bytes of context, and sums over each context."""

    def __init__(self, k: int, keys: np.ndarray, counts: np.ndarray, below: Level | None) -> None:
        self.k = k
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen]
        context = self.keys >> U(8)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, int)
        self.context = context[at]
        self.total = np.add.reduceat(self.counts, at) if len(at) else self.counts
        self.distinct = np.diff(np.append(at, len(context)))
        # what the context one byte shorter has of the symbols seen here: excluded there after an escape
        shorter = _lookup(below.keys, below.counts, self.keys & U((1 << (8 * k)) - 1)) if below is not None else np.zeros(len(self.keys), np.int64)
        self.excluded = np.add.reduceat(shorter, at) if len(at) else shorter


def _levels(keys: np.ndarray, counts: np.ndarray, top: int, bottom: int, below: Level | None) -> list[Level]:
    """Levels from ``bottom`` to ``top`` of context bytes; the shorter ones are sums over the first byte."""
    tables = {top: (keys, counts)}
    for k in range(top - 1, bottom - 1, -1):
        tables[k] = _sum(tables[k + 1][0] & U((1 << (8 * (k + 1))) - 1), tables[k + 1][1])
    out = []
    for k in range(bottom, top + 1):
        below = Level(k, *tables[k], below)
        out.append(below)
    return out


def code_lengths(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol after its context, by the levels from no context to the longest."""
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
    out_total, out_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for level in reversed(levels):
        key = grams & U((1 << (8 * (level.k + 1))) - 1)
        context = key >> U(8)
        count, total, distinct = _lookup(level.keys, level.counts, key), _lookup(level.context, level.total, context), _lookup(level.context, level.distinct, context)
        left, fresh = total - out_total, distinct - out_distinct
        hit = open_ & (count > 0)
        out[hit] += np.log10((count[hit] - 0.5) / left[hit])
        escape = open_ & (count == 0) & (total > 0) & (fresh > 0)
        out[escape] += np.log10(0.5 * fresh[escape] / left[escape])
        open_ &= ~hit
        out_total, out_distinct = _lookup(level.context, level.excluded, context), distinct
    symbols = len(levels[0].keys)
    out[open_] -= np.log10(max(1, 256 - symbols))
    return out


def _ask(table: pa.Table) -> pa.Table:
    """A block's distinct keys with their training counts, a row for each bucket, and the counts of its short grams."""
    block, rows = table.column("block")[0].as_py(), []
    times = np.where(table.column("held").to_numpy(), 0, table.column("times").to_numpy())
    with np.errstate(over="ignore"):
        for kind, (keys, counts) in _wanted(_texts(table), times).items():
            bucket = _bucket(kind, keys)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange((1 << BITS) + 1))
            keys_, counts_ = keys[order], counts[order]
            rows += [(kind, block // SLAB, b, block, _pack_keys(keys_[i:j]), _pack(counts_[i:j])) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
            if kind == GRAM:
                low, n = _sum(_turned_back(keys) & U((1 << 8 * MIDDLE) - 1), counts)
                rows.append((LOW, block // SLAB, 0, block, _pack_keys(low[n > 0]), _pack(n[n > 0])))
    return _table(rows)


def _gather(table: pa.Table) -> pa.Table:
    """Sums of the counts of a bucket over one slab, as a row of the next larger one."""
    kind, slab, bucket = (table.column(c)[0].as_py() for c in ("kind", "slab", "bucket"))
    keys, counts = _sum(np.concatenate([_unpack_keys(k) for k in table.column("keys").to_pylist()]), np.concatenate([_unpack(v, np.int64) for v in table.column("vals").to_pylist()]))
    return _table([(kind, slab // SLAB, bucket, slab, _pack_keys(keys), _pack(counts))])


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What the model has for the keys of each block of a slab, in the order asked."""
    if not asked.num_rows:
        return _table([])
    kind, value = asked.column("kind")[0].as_py(), np.float64 if asked.column("kind")[0].as_py() == GRAM else np.int64
    keys, values = _unpack_keys(model.column("keys")[0].as_py()), _unpack(model.column("vals")[0].as_py(), value)
    return _table([(kind, 0, b, block, None, _pack(_lookup(keys, values, _unpack_keys(k)))) for b, block, k in zip(*(asked.column(c).to_pylist() for c in ("bucket", "block", "keys")), strict=True)])


@tidy("answers")
def _answers(placed: DataFrame, slabs: int) -> DataFrame:
    """For every block, kind and bucket: code lengths of the block's grams and training counts of its words.

    Rows of kind LOW have the numbers of distinct words and of words learned from, in the first and second place.
    """
    asked = settle(placed.groupBy("block").applyInArrow(_ask, _PACKED), "asked")
    totals, left = asked, slabs
    while True:  # each round has a part in SLAB of the rows before
        totals = settle(totals.groupBy("kind", "slab", "bucket").applyInArrow(_gather, _PACKED), "totals")
        if left == 1:
            break
        left = -(-left // SLAB)

    # Contexts of fewer than MIDDLE bytes: one row, of at most 256**MIDDLE counts, however large the corpus.
    low = totals.where(F.col("kind") == LOW).select("keys", "vals").first()
    sent = placed.sparkSession.sparkContext.broadcast((_unpack_keys(low["keys"]), _unpack(low["vals"], np.int64)) if low else (np.zeros(0, U), np.zeros(0, np.int64)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code lengths of a bucket's grams, counts of its words, and how many these are."""
        for batch in batches:
            for kind, bucket, k, v in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "keys", "vals")), strict=True):
                counts, rows = _unpack(v, np.int64), []
                if kind == WORD:
                    rows = [(WORD, 0, bucket, 0, k, v), (LOW, 0, bucket, 0, None, np.array([np.count_nonzero(counts), counts.sum()], dtype=np.int64).tobytes())]
                elif kind == GRAM:
                    grams = _turned_back(_unpack_keys(k))
                    levels = _levels(*sent.value, MIDDLE - 1, 0, None)
                    levels += _levels(*_sum(grams, counts), ORDER, MIDDLE, levels[-1])
                    rows = [(GRAM, 0, bucket, 0, k, _pack(code_lengths(grams, levels)))]
                if rows:
                    yield _table(rows).to_batches()[0]

    model = settle(totals.mapInArrow(learn, _PACKED), "model")
    each = model.where(F.col("kind") != LOW).withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))))
    told = asked.where(F.col("kind") != LOW).groupBy("kind", "slab", "bucket").cogroup(each.groupBy("kind", "slab", "bucket")).applyInArrow(_answer, _PACKED)
    return told.unionByName(model.where(F.col("kind") == LOW)).select("kind", "bucket", "block", "vals")


@tidy("scores")
def ppm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Base and PPM scores of every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``held_out`` is true are not learned from. ``base_score`` is the
    add-one unigram score of the words and the end; ``score`` the model's log10
    probability of the text in token form. NULL counts as the empty text, whose
    one token is the end. Whole texts are coded, however long. Texts of more than
    an eighth of a block lie in blocks apart, of which there are four for each
    such text, so that few meet; the others fill blocks of about ``block_bytes``
    by their hash. Repeated rows are scored each and learned from
    each (they meet in one block, where they are kept once with their number).
    With nothing to learn from every symbol has probability 1/256. Only the
    columns that are named are read; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    n, long = F.octet_length("text"), F.octet_length("text") > block_bytes // 8
    size = docs.agg(F.sum(F.when(~long, n)).alias("bytes"), F.count_if(long).alias("long"), F.count_if(~F.col("held")).alias("train")).first()
    short, train_docs = max(1, -(-(size["bytes"] or 0) // block_bytes)), size["train"]
    blocks = short + 4 * size["long"]
    own = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks - short))) + short
    placed = docs.withColumn("block", F.when(long, own).otherwise(F.pmod(F.xxhash64("id", "text"), F.lit(short))).cast("long")).repartition("block")
    placed = placed.groupBy("block", "id", "text", "held").agg(F.count("*").alias("times"))  # stays where it is
    answers = _answers(placed, -(-blocks // SLAB))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([np.frombuffer(x, dtype=np.int64) for x in b.column(0).to_pylist()]).reshape(-1, 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(v[0])]), pa.array([int(v[1])])], names=["v", "n"])

    # V and N: two numbers from each bucket.
    words = answers.where(F.col("kind") == LOW).select("vals").mapInArrow(add, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_tokens, distinct = words["n"] + train_docs, words["v"] + (1 if train_docs else 0)

    def score(documents: pa.Table, told: pa.Table) -> pa.Table:
        texts, times = _texts(documents), np.where(documents.column("held").to_numpy(), 0, documents.column("times").to_numpy())
        out = {c: [np.zeros(0)] for c in ("n_tokens", "n_known", "base", "score")}
        with np.errstate(over="ignore"):
            wanted = _wanted(texts, times)
            value = {}
            for kind, of in ((GRAM, np.float64), (WORD, np.int64)):
                rows = sorted((b, v) for k, b, v in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "vals")), strict=True) if k == kind)
                keys = wanted[kind][0]
                value[kind] = np.zeros(len(keys), of)
                value[kind][np.argsort(_bucket(kind, keys), kind="stable")] = np.concatenate([np.zeros(0, of), *(_unpack(v, of) for _, v in rows)])
            index = {kind: pd.Index(wanted[kind][0]) for kind in (GRAM, WORD)}
            scale = np.log10(n_tokens + distinct + 1)
            for start, end in chunks(texts):
                part = texts[start:end]
                keys, first = _grams(part)
                out["score"].append(np.add.reduceat(value[GRAM][index[GRAM].get_indexer(_turned(keys))], first))
                hashes, at = word_hashes(part)
                count = np.append(value[WORD][index[WORD].get_indexer(hashes)] if len(hashes) else [], [0.0])
                sums = np.concatenate([[0.0], np.cumsum(np.log10(count + 1) - scale)])
                known = np.concatenate([[0], np.cumsum(count > 0)])
                out["n_tokens"].append(np.diff(at) + 1)
                out["n_known"].append(known[at[1:]] - known[at[:-1]] + (1 if train_docs else 0))
                out["base"].append(sums[at[1:]] - sums[at[:-1]] + np.log10(train_docs + 1) - scale)
        n = len(texts)
        columns = [documents.column("id"), documents.column("held"), *(np.concatenate(out[c]).astype(np.int64) for c in ("n_tokens", "n_known")), np.full(n, n_tokens), np.concatenate(out["base"]), np.concatenate(out["score"]), documents.column("times")]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"])

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long"
    scored = placed.groupBy("block").cogroup(answers.where(F.col("kind") != LOW).groupBy("block")).applyInArrow(score, schema)
    return scored.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times").withColumnRenamed("id", id_col)


def held_out_fold(id_col: str = "doc_id", modulus: int = 7, fold: int = 2) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``fold``."""
    return split_key(id_col, modulus) == fold
