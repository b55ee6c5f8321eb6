"""Landed replies as a Spark data source: ``spark.read.format("replies")``, and the same as a stream.

A reply is a file, or a line of one. Rows are (file, place, payload); what a
payload means is said by ``feeds.articles``, in built-in functions, for tables and
streams alike. Options: ``path`` (a file or folder), ``lines`` (true: a reply a
line), ``split_bytes`` (bytes of a task), ``quiet_seconds`` (streams: age from
which a file is taken to be whole).
"""

from __future__ import annotations

import io
import re
import time
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, place long, payload string"
#: Bytes that one task reads unless the option says otherwise, and of one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 1 << 20
#: Files that are read from their start to their end, as they cannot be cut.
PACKED = (".gz", ".bz2", ".zst", ".lz4")


class Piece(NamedTuple):
    """The bytes of a file from ``start`` up to ``end``."""

    file: str
    start: int
    end: int


class Pieces(InputPartition):
    """What one task reads: part of a large file, or several small ones."""

    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(pieces)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Landed:
    """The files at a path, how they are cut, and how a piece is read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.lines = str(options.get("lines", "false")).lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.quiet = float(options.get("quiet_seconds", 2))
        if self.split < 1:
            raise ValueError("split_bytes must be positive")

    def files(self) -> list[pafs.FileInfo]:
        """Data files in the order of their names; names that begin with a dot or an underscore are none."""
        fs, path = _opened(self.path)
        found = fs.get_file_info(path)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no such path: {self.path}")
        if found.type == pafs.FileType.Directory:
            listed = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        else:
            listed = [found]
        inside = lambda f: f.path[len(path):].split("/")
        return sorted((f for f in listed if f.is_file and not any(p[:1] in ("_", ".") for p in inside(f))), key=lambda f: f.path)

    def cut(self, files: list[pafs.FileInfo]) -> list[Pieces]:
        """Pieces of at most ``split`` bytes where a file can be cut, small ones put together up to that size."""
        out: list[list[Piece]] = []
        room = 0
        for f in files:
            step = self.split if self.lines and not f.path.endswith(PACKED) else max(f.size, 1)
            for start in range(0, f.size, step):
                piece = Piece(f.path, start, min(start + step, f.size))
                if piece.end - piece.start > room:
                    out.append([])
                    room = self.split
                out[-1].append(piece)
                room -= piece.end - piece.start
        return [Pieces(p) for p in out]

    def _replies(self, fs: pafs.FileSystem, piece: Piece) -> Iterator[tuple[int, bytes]]:
        """Where a reply begins and its bytes. A line belongs to the piece that has its first byte."""
        packed = piece.file.endswith(PACKED)
        source = fs.open_input_stream(piece.file, compression="detect") if packed else fs.open_input_file(piece.file)
        with io.BufferedReader(source, BATCH_BYTES) as f:
            if not self.lines:
                yield 0, f.read()
                return
            at = piece.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while (packed or at < piece.end) and (line := f.readline()):
                yield at, line
                at += len(line)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "place", "payload"])

        for piece in partition.value:
            for at, raw in self._replies(fs, piece):
                text = raw.decode("utf-8-sig" if at == 0 else "utf-8", errors="replace")
                if self.lines:
                    text = text.removesuffix("\n").removesuffix("\r")
                if not text.strip():
                    continue
                rows.append((piece.file, at, text))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class RepliesReader(DataSourceReader):
    def __init__(self, landed: Landed) -> None:
        self.landed = landed

    def partitions(self) -> list[Pieces]:
        return self.landed.cut(self.landed.files()) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.landed.read(partition)


class RepliesStream(DataSourceStreamReader):
    """Files by the time of their last change. An offset is the greatest time that was read, so it does not grow with the files.

    Files younger than ``quiet_seconds`` wait, so that none that is still written, or
    that lands at the same moment as one already read, is missed. A file that is
    changed later is read again, whole.
    """

    def __init__(self, landed: Landed) -> None:
        self.landed = landed

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        whole = time.time_ns() - int(self.landed.quiet * 1e9)
        return {"changed": max((f.mtime_ns for f in self.landed.files() if f.mtime_ns <= whole), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        new = [f for f in self.landed.files() if start["changed"] < f.mtime_ns <= end["changed"]]
        return self.landed.cut(new) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.landed.read(partition)


class Replies(DataSource):
    """The data source ``replies``."""

    @classmethod
    def name(cls) -> str:
        return "replies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepliesReader(Landed(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RepliesStream(Landed(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The replies at ``path``: ``file``, ``place`` (first byte of the reply in it) and ``payload``.

    Blank replies are passed over, an empty folder gives no rows, a path that is
    not there is an error, bytes that are no UTF-8 become replacement characters.
    The path must be one that pyarrow can open: a local or shared folder, hdfs, s3, gs.
    """
    spark.dataSource.register(Replies)
    return spark.read.format("replies").options(path=path, **options).load()


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The replies that land at ``path``, as a stream of the rows of ``read``."""
    spark.dataSource.register(Replies)
    return spark.readStream.format("replies").options(path=path, **options).load()
