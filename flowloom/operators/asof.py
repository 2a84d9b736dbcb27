"""As-of joins: to every row the last version at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.scan import Measure, running

#: Time per block of the scan, in microseconds.
BLOCK_US = 3_600_000_000


def as_of(rows: DataFrame, versions: DataFrame, us: Column, valid_us: Column, version: str, name: str = "in_force", block_us: int = BLOCK_US) -> DataFrame:
    """`rows` with struct `name`, the row of `versions` in force at their time; null before the first.

    `us` is the time of a row, `valid_us` the time from which a version holds, both in microseconds; of
    versions from the same time the one with the greatest `version` holds. Both tables are laid on one
    axis and the last version is carried along in blocks of time, so no range join is needed and every
    row is read once.
    """
    columns = F.struct(*versions.columns)
    marks = versions.select(valid_us.alias("_us"), F.lit(0).alias("_kind"), F.col(version).alias("_version"), columns.alias("_value"))
    marks = marks.withColumn("_mark", F.struct("_us", "_version", "_value"))
    axis = rows.withColumns({"_us": us, "_kind": F.lit(1)}).unionByName(marks.select("_us", "_kind", "_mark"), allowMissingColumns=True)
    axis = axis.withColumn("_block", F.floor(F.col("_us") / block_us))
    found = running(axis, [], "_block", ["_us", "_kind"], {"_last": Measure("max", F.col("_mark"))})
    return found.where("_kind = 1").select(*rows.columns, F.col("_last._value").alias(name))
