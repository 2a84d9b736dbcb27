"""Class counts, weights, candidate models, blocked cross-validation and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(divided: DataFrame) -> DataFrame:
    return divided.groupBy("label").agg(
        F.count("*").alias("flows"),
        F.count_if("is_train").alias("train"),
        F.count_if(~F.col("is_train")).alias("test"),
    )


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(  # a row per class
        F.collect_list(F.struct(label, "n")).alias("c"), F.sum("n").alias("rows"), F.count("*").alias("classes")
    ).select(F.inline("c"), "rows", "classes")
    return whole.select(label, "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


def column_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of each column, all in one pass."""
    one = df.agg(
        *[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in names]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), f"{n}.mean", f"{n}.std") for n in names])
    return one.select(F.inline(pairs))
