"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: whole texts are wide, and a batch is in memory several times on its way to Python and back.
BATCH_BYTES = 2 << 20
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}

#: Written tables of the innermost ``tidy`` call, which nobody reads once its result is written.
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("presswork_open", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read lazily by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a temporary folder
    made and set as the checkpoint folder of the context; on a cluster that
    names none this is an error, as executors would not see each other's files.
    """
    set_by = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_by is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        set_by = tempfile.mkdtemp(prefix="presswork-")
        spark.sparkContext.setCheckpointDir(set_by)
        set_by = spark.sparkContext.getCheckpointDir()
    return set_by


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path for a written intermediate table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that has no reader left."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on no Arrow batch of this session has more than about ``size`` bytes (one row at least).

    Operators whose lazy plans send texts to Python call this, as batches are
    cut when a plan runs, which may be long after the call. A smaller bound stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get(key).strip().lower())
    if not m or not 0 < int(m[1]) << _UNITS[m[2]] <= size:
        spark.conf.set(key, str(size))


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside delete their shuffle files when they end: what they wrote is read from the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs a reread rather than a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    bound_batches(spark)
    with _shuffles_freed(spark):
        df.write.parquet(path)
    if (mine := _open.get()) is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(tag: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions that settle tables on their way to a result: the result is
    settled too, and the tables before it are deleted, since none is read again."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **how) -> DataFrame:
            paths: list[str] = []
            outer = _open.set(paths)
            spark = None
            try:
                out = f(*args, **how)
                spark = out.sparkSession
            finally:
                _open.reset(outer)
            out = settle(out, tag)
            for path in paths:
                discard(spark, path)
            return out

        return run

    return wrap
