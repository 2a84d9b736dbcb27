"""Cleaning of labelled flows: rare classes, negative durations, copies, contradictions.

Input columns: `source_file`, `raw_label`, an order (`capture_order` alone or with a block column
before it) and the source columns of a flow CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.flows import (
    class_index,
    from_source_columns,
    is_rare,
    label_class,
    label_text,
)
from flowloom.registry import CLASSES, FEATURE_NAMES, LABELS, RARE_LABELS


def unknown_labels(raw: DataFrame, mapped=tuple(LABELS), left_out=RARE_LABELS) -> DataFrame:
    """Labels that are neither mapped nor left out."""
    spark = raw.sparkSession
    known = spark.createDataFrame([(t,) for t in [*mapped, *left_out]], "label_text string")
    seen = raw.select(label_text(F.col("raw_label")).alias("label_text")).distinct()
    return seen.join(known, "label_text", "left_anti").orderBy("label_text")


def require_known_labels(raw: DataFrame) -> None:
    """Fail early, naming the unknown labels in order (the first hundred of them)."""
    found = [row.label_text for row in unknown_labels(raw).limit(100).collect()]
    if found:
        raise ValueError(f"unmapped labels: {found}")


def labelled_features(raw: DataFrame, order: list[str]) -> DataFrame:
    """Features, normalised label, class index and the two drop reasons, one row per input row."""
    text = label_text(F.col("raw_label"))
    keep = [F.col("source_file"), *[F.col(c) for c in order]]
    rows = from_source_columns(raw, [*keep, text.alias("label_text"), is_rare(text).alias("rare")])
    known = F.when(~F.col("rare"), label_class(F.col("label_text")))
    return rows.withColumn("class_id", class_index(known)).withColumn(
        "negative", ~F.col("rare") & (F.col("flow_duration_s") < 0)
    )


def vectors(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct feature vector: copies, the classes seen, the first row in load order.

    Copies collapse on the map side, so a vector repeated billions of times costs one row per task.
    The fingerprint leads the grouping key only to make comparisons cheap; the features stay in the
    key, so two vectors with one fingerprint are never merged.
    """
    kept = rows.filter(~F.col("rare") & ~F.col("negative"))
    kept = kept.withColumn("fingerprint", F.xxhash64(*FEATURE_NAMES))
    first = F.struct("source_file", *order, "label_text", "class_id")
    return kept.groupBy("fingerprint", *FEATURE_NAMES).agg(
        F.count("*").alias("copies"),
        F.bit_or(F.expr("shiftleft(1, class_id)")).alias("class_bits"),
        F.min(first).alias("first"),
    )


def clean(raw: DataFrame, order: list[str] = ["capture_order"]) -> DataFrame:
    """Rows kept: the first of each vector whose copies agree on the class.

    Dropping copies per (vector, class) and then every vector left with two classes is the same as
    keeping the first row of the vectors seen with one class, so both steps are one aggregation.
    """
    grouped = vectors(labelled_features(raw, order), order)
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return grouped.filter(F.bit_count("class_bits") == 1).select(
        "first.source_file",
        *[F.col(f"first.{c}").alias(c) for c in order],
        F.concat_ws("|", "first.source_file", "first.label_text").alias("grp"),
        F.element_at(classes, F.col("first.class_id") + 1).alias("label"),
        *FEATURE_NAMES,
    )


def cleaning_report(raw: DataFrame, order: list[str] = ["capture_order"]) -> DataFrame:
    """One row of counts: what was loaded, dropped for which reason, and kept.

    Rows that are dropped for their label or duration have no vector, so each reason is one group beside
    the vectors and the input is read once.
    """
    rows = labelled_features(raw, order)
    reason = F.when(F.col("rare"), 1).when(F.col("negative"), 2).otherwise(0)
    rows = rows.withColumn("reason", reason)
    vector = {n: F.when(F.col("reason") == 0, F.col(n)) for n in FEATURE_NAMES}
    rows = rows.withColumns(vector).withColumn("fingerprint", F.xxhash64(*FEATURE_NAMES))
    grouped = rows.groupBy("reason", "fingerprint", *FEATURE_NAMES).agg(
        F.count("*").alias("copies"), F.bit_or(F.expr("shiftleft(1, class_id)")).alias("class_bits")
    )
    classes = F.when(F.col("reason") == 0, F.bit_count("class_bits")).cast("long")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    of = lambda n: F.when(F.col("reason") == n, F.col("copies"))
    return grouped.agg(
        total("copies").alias("rows_loaded"),
        total(of(1)).alias("dropped_rare_classes"),
        total(of(2)).alias("dropped_negative_duration"),
        total(of(0) - classes).alias("dropped_exact_duplicates"),
        total(F.when(classes > 1, classes)).alias("dropped_conflicting_labels"),
        F.count_if(classes == 1).alias("rows_kept"),
    )
