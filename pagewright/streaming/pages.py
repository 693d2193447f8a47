"""Structured Streaming over a folder of recognised pages: each new file goes through the same batch functions.

Page-local operators need no state and no watermark. foreachBatch writes each micro-batch once: an output folder a batch
number, replaced if the batch is tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import readers


def recognised_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Recognised lines of JSON files as they appear in folder/<document>/<page>.json."""
    raw = spark.readStream.schema(readers.LINES).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).json(folder)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    return readers.recognised_lines(raw.withColumns({"doc_id": readers.document(F.col("path")), "page": readers.page_number(F.col("path"))}))


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply work to every micro-batch and write it below out/batch=<number>."""

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
