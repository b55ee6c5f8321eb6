"""The idempotent labelling stage as a stream over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from presswork.operators.labelling import Labeller, run_stage


def label_stream(spark: SparkSession, landed: str, schema: str, results: str, checkpoint: str, labeller: Labeller) -> StreamingQuery:
    """Label each landed article once, in micro-batches, until nothing is left.

    A batch that is retried after a failure adds nothing twice: rows already in
    the results are taken out before the labeller sees them.
    """

    def each(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        shape = "article_id long, label string, confidence double, method string, error string"
        try:
            done = session.read.schema(shape).parquet(results)
        except Exception as e:  # before the first batch there are no results
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = session.createDataFrame([], shape)
        run_stage(batch.dropDuplicates(["id"]), done, labeller).write.mode("append").parquet(results)

    stream = spark.readStream.schema(schema).parquet(landed)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
