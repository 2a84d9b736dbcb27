"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles methods of more bytecode than this; steps that would need one run apart instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Partitions of a stream's state per core at most, and MB that all of an executor's RocksDBs take for buffers
#: and caches. Each partition is an open RocksDB with memory outside the heap, whatever it holds.
STATE_PARTITIONS, STATE_MB = 16, 256
PARTITIONS = "spark.sql.shuffle.partitions"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def shuffled(spark: SparkSession, partitions: int):
    """Shuffles planned in this block have so many partitions."""
    given = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, partitions)
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, given)


def state_partitions(spark: SparkSession) -> int:
    """Chooses the state store of streams and says in how many partitions their state is to lie: as many as
    shuffles have, but no more than the cores can use. A stream takes the number over when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", STATE_MB)
    return min(int(spark.conf.get(PARTITIONS)), STATE_PARTITIONS * spark.sparkContext.defaultParallelism)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="flowloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder, because there the driver and the
    tasks are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder: what follows survives lost executors without
    recomputing it, and iterative jobs do not ship its whole history with every task."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: later jobs read the columns they
    need, and lost executors cost nothing of it."""
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


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
