"""What the operators share: reading tables, cutting lineage in the shared folder, component labels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and its rows times their width stay below this many bytes.
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch at most about: a batch lies in memory several times, in the JVM and in the Python worker.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, after its session's limit on the bytes of Arrow batches is lowered to ARROW_BYTES."""
    conf = df.sparkSession.conf
    now = str(conf.get(_ARROW, "64m")).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        conf.set(_ARROW, str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder; with columns, only those."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key as a long and those columns; rows with a null key are left out."""
    return bounded(df).select(F.col(key).cast("long").alias(key), *columns).where(F.col(key).isNotNull())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own serves a local
    session (tests); on a cluster there is no folder that we may choose, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here and survives lost executors.

    The folder goes when the application ends, or by drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if name.rpartition("/")[2].startswith("cut-"):
                files, at = _files(df.sparkSession, name)
                files.delete(at, True)


def lean(run):
    """run, a function for mapInArrow, after which the worker gives its free memory back: workers live on after a stage."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def runs(batches, *names: str):
    """Tables of the rows with equal values of these columns (not null), which come one after the other."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows - 1, bool)
        for n in names:
            c = b.column(n)
            new |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(new) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = [b.column(n)[a].as_py() for n in names]
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession, total_bytes: float, each: float) -> int:
    """Partitions for that many bytes: at least the session's count, so the number follows the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes // each) + 1)


def small(df: DataFrame, width: int) -> DataFrame:
    """df, marked for broadcast if its counted rows times width fit BROADCAST_BYTES. df must be cheap to count (a cut)."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges (long columns a, b); component is the smallest node reachable.

    Minimum labels travel along edges and then jump to the label's own label, so the rounds follow the logarithm of a
    chain's length. Aggregates are partial before their shuffle; nothing but one sum a round reaches the driver.
    Null ends and loops are dropped; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = cut(pairs.union(pairs.select("v", "u")).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    last = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now is None or now == last:
            drop(both)
            return labels
        last = now
        near = both.join(labels, both.u == labels.node).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("c"))
        near = near.join(labels, "node").select("node", F.least("c", "component").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("component").alias("top"))
        before, labels = labels, cut(near.join(up, "c", "left").select("node", F.least("c", F.coalesce("top", "c")).alias("component")))
        drop(before)
