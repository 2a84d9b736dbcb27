"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of two or three numbers that a broadcast may hold: about 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of partitions the session shuffles into, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, else as it is: the join shuffles."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def long_rows(spark: SparkSession) -> None:
    """Texts are long, so batches for Python get fewer rows than Spark's default of ten thousand,
    unless the session says otherwise."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(work: Callable) -> Callable:
    """`work` over the batches of a task, with freed memory given back to the system before and after.

    A worker lives on from stage to stage, and the allocators keep what a stage has freed for the same
    process: beside the next stage's tables and the executor's heap that adds up.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return what this process has freed to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: columns that are not needed later
    are not read, and lost executors cost nothing of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete `stored` tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
