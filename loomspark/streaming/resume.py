"""Append with resume as a stream: each record file is scored once, whatever is restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomspark.sources.io import SCHEMAS


def follow(spark: SparkSession, folder: str, kind: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Process the files of folder that no run has processed, append to target and end. The checkpoint is the resume state."""
    rows = spark.readStream.schema(SCHEMAS[kind]).json(folder)
    return transform(rows).writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_batches(
    spark: SparkSession, folder: str, kind: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, every: int = 100, write: Callable[[DataFrame, str], None] | None = None
) -> StreamingQuery:
    """The same in batches of at most so many files, each of which is safe once it is written; a run that ends half-way loses no more than one batch.

    Every batch has a folder of its own below target, batch=<number>, and replaces what an earlier try has left there, so whoever reads target with any
    reader finds each record once, as soon as the batch that a killed run had begun is done again. write(frame, path) must replace path; JSON lines by default.
    """
    put = write or (lambda df, path: df.write.mode("overwrite").json(path))

    def one(batch: DataFrame, number: int) -> None:
        put(transform(batch), f"{target}/batch={number}")

    rows = spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", every).json(folder)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
