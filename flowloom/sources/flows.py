"""Flow CSV files and connection records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.registry import CONNECTION_COLUMNS, CONNECTION_TEXT, SOURCE_COLUMNS

CSV_ORDER = ["file_block_start", "row_id"]


def _read_csvs(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("header", True).option("encoding", "ISO-8859-1")
    # a file whose header differs from the others' fails instead of being read by position
    raw = read.option("enforceSchema", False).csv(path)
    stripped = {c.strip(): c for c in raw.columns}
    missing = [c for c in [*SOURCE_COLUMNS, "Label"] if c not in stripped]
    if missing:
        raise ValueError(f"flow files lack columns: {missing}")
    return raw.select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col(f"`{stripped['Label']}`").alias("raw_label"),
        *[F.col(f"`{stripped[c]}`").alias(c) for c in SOURCE_COLUMNS],
    )


def read_flow_csvs(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of flow CSVs with their place in the capture.

    Within a file, (file_block_start, row_id) is the row order: splits are cut at growing offsets
    and one task reads a split from front to back. Files of another column order go in as another
    path.
    """
    if not paths:
        raise FileNotFoundError("no CSV files given")
    return reduce(DataFrame.unionByName, [_read_csvs(spark, p) for p in paths])


def first_rows(flows: DataFrame, n: int) -> DataFrame:
    """The first n rows in load order."""
    return flows.orderBy("source_file", *CSV_ORDER).limit(n)


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Connection records: no header, columns by position."""
    schema = ", ".join(f"`{c}` {'string' if c in CONNECTION_TEXT else 'double'}" for c in CONNECTION_COLUMNS)
    return spark.read.schema(schema).csv(path)


def dataset_digest(spark: SparkSession, path: str) -> DataFrame:
    """One digest over the names and lines of all files.

    Each line is hashed where it is read; a file is the count and two sums of its line hashes, so
    files of any size work and nothing is read whole. It tells changed data apart; it is not the
    hash of the bytes, and the order of lines does not count.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), F.sha2("value", 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", i, 12), 16, 10).cast("decimal(38,0)"))
    files = lines.groupBy("name").agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"))
    text = F.concat_ws(":", "name", "n", "a", "b")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias("digest"))
