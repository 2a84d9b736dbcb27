"""Scoring flows with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.alerts import percent
from flowloom.plans.explain import contributions, top_features
from flowloom.plans.models import score
from flowloom.registry import BENIGN, CLASSES

ITEM = "array<struct<feature:string,value:double,contribution:double,weight:double>>"


def prediction_columns(proba: Column, classes=CLASSES) -> dict[str, Column]:
    """Label, confidence and class map of a probability array."""
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_position(proba, F.array_max(proba)).cast("int") - 1
    rounded = F.transform(proba, lambda p: F.round(p, 4))
    label = F.get(names, best)
    return {
        "label": label,
        "confidence": F.round(F.array_max(proba), 4),
        "class_probs": F.map_from_arrays(F.slice(names, F.lit(1), F.size(proba)), rounded),
        "is_attack": label != BENIGN,
    }


def summary_line(label: Column, confidence: Column) -> Column:
    found = F.concat(label, F.lit(" detected — confidence "), percent(confidence))
    return F.when(label == BENIGN, F.concat(F.lit("Benign traffic — confidence "), percent(confidence))).otherwise(found)


def predict(
    model: PipelineModel, flows: DataFrame, background: DataFrame, explain: str = "attacks", k: int = 5
) -> DataFrame:
    """Flows with label, confidence, class_probs, is_attack, summary and explanation.

    `explain` is attacks (the default), all or none; flows outside it get an empty explanation.
    """
    if explain not in ("attacks", "all", "none"):
        raise ValueError("explain must be attacks, all or none")
    done = score(model, flows)
    done = done.withColumns(prediction_columns(F.col("proba")))
    done = done.withColumn("summary", summary_line(F.col("label"), F.col("confidence")))
    empty = F.array().cast(ITEM)
    if explain == "none":
        return done.withColumn("explanation", empty)
    wanted = F.col("is_attack") if explain == "attacks" else F.lit(True)
    done = done.withColumn("parts", contributions(model, background, F.col("pred"), wanted))
    return done.withColumn("explanation", F.coalesce(top_features(F.col("parts"), k=k), empty)).drop("parts")
