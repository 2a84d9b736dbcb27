"""Train and test by capture order, folds, and row caps per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.scan import Measure, id_block, running, smallest_by_hash
from flowloom.registry import FOLDS, TRAIN_SHARE


def temporal_split(
    cleaned: DataFrame, order: list[str] = ["capture_order"], block: str | None = None
) -> DataFrame:
    """Adds position, group size, is_train and fold.

    The first 70 % of each (file, label) group in capture order train; folds are consecutive fifths
    of the training part. One benign group can be most of the data, so positions are counted in
    blocks: `block` names an order column that already is one (a file split offset), else blocks of
    2**20 capture numbers are used. `cleaned` is read three times: pass a written or checkpointed table.
    """
    blocked = cleaned if block else cleaned.withColumn("_block", id_block(F.col(order[0])))
    block = block or "_block"
    placed = running(
        blocked, ["grp"], block, order, {"position": Measure("sum", F.lit(1), inclusive=False)}
    )
    sizes = cleaned.groupBy("grp").agg(F.count("*").alias("group_size"))
    cut = F.floor(F.col("group_size") * F.lit(TRAIN_SHARE))
    share = F.col("position") / F.greatest(cut, F.lit(1)) * FOLDS
    return (
        placed.join(sizes, "grp")
        .withColumn("position", F.col("position").cast("long"))
        .withColumn("is_train", F.col("position") < cut)
        .withColumn("fold", F.least(F.floor(share), F.lit(FOLDS - 1)).cast("int"))
        .select(*cleaned.columns, "position", "group_size", "is_train", "fold")
    )


def cap_per_class(df: DataFrame, cap: int, key: str | Column, seed: int, label: str = "label") -> DataFrame:
    """At most `cap` rows of each class, the same ones on every run."""
    key = F.col(key) if isinstance(key, str) else key
    return smallest_by_hash(df, [label], key, seed, F.lit(cap))


def stratified_sample(
    df: DataFrame, rows: int, classes: int, key: str, seed: int, label: str = "label"
) -> DataFrame:
    """About `rows` rows, the same number from each class."""
    return cap_per_class(df, max(rows // classes, 1), key, seed, label)


def first_per_class(df: DataFrame, k: int, order: str, label: str = "label") -> DataFrame:
    """First k rows of each class; the group limit keeps k rows per class and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
