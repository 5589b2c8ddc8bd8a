"""A stream of changed source files that keeps a stored index up to date (beyond the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import update

FILES = "path string, content binary, length long, modificationTime timestamp"


def follow(spark: SparkSession, folder: str, checkpoint: str, index_path: str, sources: Callable[[], DataFrame], threads: DataFrame, macros: dict[str, str] | None = None) -> StreamingQuery:
    """Watches a folder; each micro-batch of new files runs the update ladder once over what sources() lists now.

    sources() gives path, text, size, mtime_ms. A batch that is retried finds the same signatures and changes nothing, so updates
    are idempotent.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            update(spark, index_path, sources(), threads, macros)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
