"""Tables that are written by key: upserts that rewrite touched partitions only, and bucketed tables that join without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators import merge
from presswork.session import discard, settle
from presswork.sources.feeds import _exists

#: Partitions of a keyed table.
PARTS = 64


class KeyedTable:
    """A Parquet table at a path in partitions by a hash of its key; at most one row for each key.

    A write reads and rewrites the partitions that its keys fall into, and no
    other. What they become is first written beside the table; if the job ends
    between, the next call of any kind puts it in place before it does anything
    else. So a write may be repeated: the same rows give the same table. One
    writer at a time. Keys may be NULL; NULL equals NULL here.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], parts: int = PARTS) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), list(key), parts
        self.pending = f"{self.path}.pending"

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))

    def _put(self, rows: DataFrame) -> None:
        """Replace the partitions that the rows (with ``part``) lie in."""
        discard(self.spark, self.pending)  # left by a write that ended before it was whole
        rows.write.parquet(self.pending)
        self._finish()

    def _finish(self) -> None:
        """Put in place what a write has left beside the table, if that is whole."""
        if _exists(self.spark, f"{self.pending}/_SUCCESS"):
            whole = self.spark.read.parquet(self.pending)
            whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
            discard(self.spark, self.pending)

    def read(self) -> DataFrame:
        self._finish()
        return self.spark.read.parquet(self.path).drop("part")

    def exists(self) -> bool:
        self._finish()
        return _exists(self.spark, f"{self.path}/part=*")  # overwriting partitions leaves no mark of success

    def _touched(self, incoming: DataFrame) -> DataFrame:
        """The stored rows of the partitions that incoming rows fall into."""
        parts = [r["part"] for r in incoming.select("part").distinct().collect()]  # at most ``parts``
        return self.spark.read.parquet(self.path).where(F.col("part").isin(parts))

    def upsert(self, rows: DataFrame, order: str) -> None:
        """Replace the rows of these keys, and add new ones; of several rows of a key the last by ``order`` counts."""
        incoming = settle(self._placed(merge.pick(rows, self.key, F.col(order))), "incoming")
        if self.exists():
            self._put(self._kept(self._touched(incoming), incoming).unionByName(incoming))
        else:
            self._put(incoming)

    def append_missing(self, rows: DataFrame, order: str) -> None:
        """Add the rows whose keys are not there, of several of a key the first by ``order``; stored rows stay as they are."""
        incoming = settle(self._placed(merge.pick(rows, self.key, F.col(order), first=True)), "incoming")
        if not self.exists():
            self._put(incoming)
            return
        stored = self._touched(incoming)
        fresh = settle(self._kept(incoming, stored), "fresh")
        if not fresh.isEmpty():
            self._put(self._touched(fresh).unionByName(fresh))

    def _kept(self, rows: DataFrame, without: DataFrame) -> DataFrame:
        """Rows whose key is not in another table."""
        other = without.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)])
        same = F.lit(True)
        for i, k in enumerate(self.key):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return rows.join(other, same, "left_anti")


def store_bucketed(rows: DataFrame, name: str, key: str, buckets: int = PARTS) -> DataFrame:
    """Write ``rows`` as a table of the catalog in buckets by ``key``, sorted inside, and read it.

    Aggregations by the key, and joins with tables that are bucketed into as
    many by their own keys, need no shuffle afterwards.
    """
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)
