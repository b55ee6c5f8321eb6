"""Token ids as ORC files: run-length encoded ids, row indexes, Bloom filters on document ids.

Documents are cut into files at exact byte counts in the order of their ids (the
splitters of ``sharding``), exchanged once, encoded where they then lie, and
written by each task as one file of several stripes. A reader that asks for some
ids skips stripes and row groups by their statistics and Bloom filters; a reader
of everything splits the files by stripes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.sharding import place, splitters
from presswork.llm.wordhash import Kept, chunks, placed_words, spread
from presswork.session import bound_batches, scratch, settle, tidy

#: Text bytes that go into one file.
FILE_BYTES = 32 << 20
#: Files at most, as the driver keeps a boundary for each; beyond that they become larger.
MAX_FILES = 1 << 14
#: Words whose ids a worker keeps (about 30 bytes each) before it starts anew, and the longest that it keeps.
CACHE, LONGEST = 1 << 19, 256
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(4 << 20),
    "orc.rows.between.memory.checks": "250",
    "compression": "zstd",
}
SCHEMA = "doc_id long, before long, ids array<int>"

#: Characters of plain texts: Latin letters, digits, stops, commas, usual white space.
_NOT_PLAIN = re.compile("[^0-9., \\n\\r\\t" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130") + "]")
#: Texts with other letters than Latin ones, unusual white space or special strings are encoded as a whole.
_WHOLE = re.compile("[^\x01-\u024f]|[\x1c-\x1f\x85\xa0\u0130]|<\\|")
_TWO_MARKS = re.compile(r"(?:[^\w\s]|_){2}")


class Encoder:
    """Ids of texts, word by word from a table, whole batches at a time.

    The vocabulary splits text at white space and lower-cases it, so a word's
    ids do not depend on its neighbours; texts where that is not certain go
    through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept = Kept("<i4", CACHE)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<i4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words in order. Words of letters alone end with one word-end token each, so they are encoded many in a line."""
        found: list[np.ndarray | None] = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for start in range(0, len(letters), 1000):
            part = letters[start : start + 1000]
            line = self._encode([" ".join(words[i] for i in part)])[0]
            at = np.flatnonzero(self.ends[line]) + 1
            if len(at) == len(part):
                for i, a, b in zip(part, [0, *at[:-1].tolist()], at.tolist(), strict=True):
                    found[i] = line[a:b]
            else:
                rest += part
        for start in range(0, len(rest), 1000):
            part = rest[start : start + 1000]
            for i, ids in zip(part, self._encode([words[i] for i in part]), strict=True):
                found[i] = ids
        return np.array([len(x) for x in found], dtype=np.int32), np.concatenate([np.zeros(0, "<i4"), *found])

    @staticmethod
    def _line(t: str) -> str | None:
        """A text whose white-space words can be encoded one by one; None if it has to be encoded as a whole."""
        if not _NOT_PLAIN.search(t):
            single = not (".." in t or ",," in t or ".," in t or ",." in t)
        elif _WHOLE.search(t):
            return None
        else:
            single = not _TWO_MARKS.search(t)
        t = t.lower()
        if single:  # single stops and commas are words of their own
            t = t.replace(".", " . ").replace(",", " , ")
        return t

    def _by_words(self, lines: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each line, and the lines with a word too long for the table."""
        with np.errstate(over="ignore"):
            joined, starts, ends, hashes, first = placed_words(lines)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)

        def new(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = example[at]
            return self._new([joined[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        begin, size = self.kept.find(distinct, new)
        size = size[which]
        ids = self.kept.values[spread(begin[which], size)]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        far = np.searchsorted(first, np.flatnonzero(ends - starts > LONGEST), side="right") - 1
        return np.split(ids, total[first[1:-1]]), np.unique(far).tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as 32-bit integers."""
        lines = [self._line(t) for t in texts]
        whole = [i for i, line in enumerate(lines) if line is None]
        plain = [i for i, line in enumerate(lines) if line is not None]
        out: list[np.ndarray] = [np.zeros(0, "<i4")] * len(texts)
        raw = [lines[i].encode() for i in plain]
        for start, end in chunks(raw):
            found, far = self._by_words(raw[start:end])
            for i, ids in zip(plain[start:end], found, strict=True):
                out[i] = ids
            whole += [plain[start + i] for i in far]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _first_bytes(text: Column) -> Column:
    """The first 7 bytes of a text as a number that is in the order of the texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.substring(text, 1, 7), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write every document's ids, then ``end_id``, to ORC files at ``path`` in ascending order of id.

    Files are in the order of their part numbers, each with about ``file_bytes``
    of text, or more where that would be over MAX_FILES files (their stripes are read
    apart); a row has the ids, and in ``before`` how many ids its file holds
    before it. NULL ids come first; rows with the same id are ordered by text, and
    one id may span files (parted by the first bytes of the texts). A NULL text is empty and leaves only
    the end id; a very long one is a file of its own. Other columns are not read.
    An empty table gives files without rows.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _first_bytes(text).alias("th"))
    # The splitters' key: first the id, then the first bytes of the text.
    rows = settle(narrow.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("h"), F.col("th").alias("id"), (F.octet_length("text") + 1).cast("long").alias("size")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    files = max(1, min(-(-total // file_bytes), MAX_FILES))
    cuts = splitters(rows, files, tolerance=0.02)
    ordered = narrow.withColumn("file", place(cuts)(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("th"))).repartitionById(files, F.col("file"))
    ordered = ordered.select("doc_id", "text").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    end = np.array([end_id], dtype="<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, before = encoder(tokenizer), 0
        for b in batches:
            got = [x for ids in e.encode(b.column(1).to_pylist()) for x in (ids, end)]
            offsets = np.zeros(b.num_rows + 1, dtype=np.int64)
            np.cumsum([len(x) + 1 for x in got[::2]], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([end[:0], *got])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before + offsets[:-1]), ids], names=["doc_id", "before", "ids"])
            before += int(offsets[-1])

    ordered.mapInArrow(run, SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files at ``path``; with ``doc_ids`` only these, pruned by statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def part_number(file: str | Column) -> Column:
    """The number of a written file; names stop being in this order from the 100,000th file on."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def file_starts(counts: DataFrame) -> DataFrame:
    """``file`` and ``offset`` (ids in all files before it) from rows of (file, n): one for each file."""
    earlier = Window.orderBy(part_number("file")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of each row, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("before"), b.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "before", "file", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).withColumn("file", F.col("_metadata.file_name")).select("doc_id", "before", "file", "ids")
    rows = settle(rows.mapInArrow(run, "doc_id long, before long, file string, n_tokens long, ids_crc32 long"), "digest")
    starts = file_starts(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")))
    return rows.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@tidy("tokens")
def tokenise_to_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **how) -> DataFrame:
    """Write ``docs`` as token files (at ``path``, or a new place in the shared folder) and return their digest."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id, **how)
    return digest(spark, path)
