"""What the operators of this subpackage share: cutting lineage, skew-proof lookups, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a class for Java, RE2 and Python.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(UPPER, LOWER)
#: Seconds between two collections of the driver's garbage, at least, and when the last one was.
RELEASE_S, _released = 3.0, [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own on a single machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="filigree-"))
    return sc.getCheckpointDir()


def uri(spark: SparkSession, path: str) -> str:
    """A path of Spark's as a URI with an authority, as other readers ask for: ``file:/a`` and ``/a`` become ``file:///a``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    scheme, rest = whole.split(":", 1)
    return whole if rest.startswith("//") else f"{scheme}://{rest}"


def release(spark: SparkSession) -> None:
    """Lets the executors delete the shuffle files of finished queries that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, and a driver whose heap stays small hardly ever does: in a
    chain of queries the files of all would add up.
    """
    if time.monotonic() - _released[0] >= RELEASE_S:
        gc.collect()
        spark._jvm.System.gc()
        _released[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of executors, the plan starts anew here, and what it shuffled before goes."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df  # else its plan holds on to its shuffle files
    release(spark)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: smaller than a checkpoint, columns can be pruned."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    schema = df.schema
    del df  # as in cut
    release(spark)
    return spark.read.schema(schema).parquet(path)


def trimmed(batches: Iterator) -> Iterator:
    """The batches, after each of which the worker gives what it has freed back to the system: workers live on between stages."""
    try:
        trim = ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        trim = None
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``most`` rows, counted; else left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, hot_share: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row per ``key``), safe where a few keys hold most rows.

    ``weight`` is a column of ``table``: how many of ``rows`` have its key.  Keys
    that hold at least a ``1/hot_share`` of all rows number ``hot_share`` at most,
    so their part of the table is broadcast whatever the data; the rest is
    shuffled, and no key of it is large.  Rows with a null key keep nulls.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = max(1000, -(-int(total) // hot_share))
    hot = table.where(F.col(weight) >= least).drop(weight)
    cold = table.where(F.col(weight) < least).drop(weight)
    keys = [r[0] for r in hot.select(key).collect()]  # hot_share of them at most
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False)) if keys else F.lit(False)
    out = rows.where(~is_hot).join(cold, key, "left")
    if keys:
        out = out.unionByName(rows.where(is_hot).join(F.broadcast(hot), key, "left"))
    return out
