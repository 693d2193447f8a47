"""Tables that are kept: scores of runs, one copy a run, and word tables whose joins by place need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.asking import shared_folder
from ..operators import spatial

#: What names a run's row.
RUN = ("date", "sample", "system")
RUNS = "commit string, version string, words long, word_acc decimal(10,4), char_acc decimal(10,4), date string, sample string, system string"


def put_runs(scores: DataFrame, path: str) -> None:
    """Store rows of RUNS: a row replaces the one with its date, sample and system, others stay.

    The rows are written aside and moved to their places when the whole job is done, so a job that fails leaves what was there,
    and one that is repeated leaves one copy. Of rows with one name the greatest counts; an empty name is a null one.
    """
    four = lambda c: F.col(c).cast("decimal(10,4)").alias(c)
    row = F.struct(F.col("commit"), F.col("version"), F.col("words").cast("long").alias("words"), four("word_acc"), four("char_acc"))
    one = scores.groupBy(*(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(c) for c in RUN)).agg(F.max(row).alias("row"))
    one.select("row.*", *RUN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; conditions on date, sample and system choose folders."""
    return spark.read.schema(RUNS).parquet(path)


def temporary(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def store_words(words: DataFrame, name: str, path: str | None = None, buckets: int | None = None, keys: tuple[str, ...] = ("page",), lie: bool = False) -> DataFrame:
    """words as the table name, in files by page that hold a row for each band (spatial.banded), and that table read again.

    Two tables with the same number of buckets join by place and are gathered by page as they lie, without an exchange. The
    number of buckets (at first that of shuffle partitions) should follow the words: a bucket of each side is what one task
    joins, and a page lies in one. lie: words are dealt to that many tasks by keys (spatial.dealt) and need not move.
    """
    spark = words.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spatial.banded(words if lie else spatial.dealt(words, n, *keys)).write.mode("overwrite").format("parquet").option("compression", "zstd")
    out = out.bucketBy(n, *keys).sortBy(*keys, spatial.ON)
    (out.option("path", path) if path else out).saveAsTable(name)
    return spark.table(name)
