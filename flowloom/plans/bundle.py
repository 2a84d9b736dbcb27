"""Saved models: pipeline, background sample, and a manifest with names and checksums."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.registry import CLASSES, FEATURE_NAMES


class BundleError(Exception):
    pass


class Bundle(NamedTuple):
    model: PipelineModel
    background: DataFrame
    classes: list[str]
    metadata: dict


def _checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every model and background file; one line per file reaches the driver."""
    found = {}
    for part in ("model", "background"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{part}")
        name = F.element_at(F.split("path", f"/{part}/"), -1)
        for row in files.select(name.alias("name"), F.sha2("content", 256).alias("sum")).collect():
            found[f"{part}/{row['name']}"] = row["sum"]
    return found


def save_bundle(
    model: PipelineModel, background: DataFrame, path: str, metadata: dict, features=FEATURE_NAMES
) -> str:
    spark = background.sparkSession
    model.write().save(f"{path}/model")
    background.select(*features).write.parquet(f"{path}/background")
    manifest = {"features": list(features), "classes": list(CLASSES), "metadata": metadata}
    manifest["checksums"] = _checksums(spark, path)
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def load_bundle(spark: SparkSession, path: str, features=FEATURE_NAMES) -> Bundle:
    """The saved model, refused if a file changed or the feature list is another one."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except AnalysisException as exc:
        raise BundleError(f"no model bundle at {path}") from exc
    if _checksums(spark, path) != manifest["checksums"]:
        raise BundleError("checksum mismatch; refusing to load")
    if manifest["features"] != list(features):
        raise BundleError("the bundle was trained on other features")
    model = PipelineModel.load(f"{path}/model")
    return Bundle(model, spark.read.parquet(f"{path}/background"), manifest["classes"], manifest["metadata"])
