"""Functions of texts as Arrow columns.

Only the texts travel to Python; the other columns of a row wait in the JVM,
where Spark may spill them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from presswork.session import bound_batches

#: Texts handled at once; a batch is bounded by bytes besides (``bound_batches``).
SLICE = 256

Work = Callable[[list[str | None]], pa.Array]


def per_text(spark: SparkSession, make: Callable[[], Work], returns: str) -> Callable[[Column], Column]:
    """A column function that gives every text what ``make()`` gives it; ``make`` is called once in each task."""
    bound_batches(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for texts in batches:
            yield pa.concat_arrays([work(texts.slice(i, SLICE).to_pylist()) for i in range(0, max(1, len(texts)), SLICE)])

    return F.arrow_udf(run, returns)
