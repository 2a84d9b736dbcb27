"""Candidate classifiers as Spark ML pipelines, blocked cross-validation, comparison, selection.

Every pipeline starts with the same preprocessing (features in fixed order, signed logarithm), so it
is saved with the model and cannot drift between training and scoring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.flows import class_index
from flowloom.operators import evaluate
from flowloom.operators.scan import beside
from flowloom.operators.split import cap_per_class
from flowloom.plans.boosting import SoftmaxBoosting
from flowloom.plans.training import class_weights
from flowloom.registry import CLASSES, CONNECTION_FEATURES, FEATURE_NAMES
from flowloom.session import cut_lineage


def preprocessing(features: list[str] = FEATURE_NAMES, out: str = "features") -> list:
    logged = ", ".join(f"signum({n}) * log1p(abs({n})) AS log_{n}" for n in features)
    return [
        SQLTransformer(statement=f"SELECT *, {logged} FROM __THIS__"),
        VectorAssembler(inputCols=[f"log_{n}" for n in features], outputCol=out),
    ]


COLUMNS = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}


#: Models that are fitted side by side. Their jobs are many and short; tasks in flight, and so the memory
#: that they take, are bounded by the cores all the same.
AT_ONCE = len(CLASSES)


def side_by_side(work: Callable, items: list) -> list:
    """What `work` gives for each item, in their order."""
    if not items:
        return []
    with ThreadPool(min(AT_ONCE, len(items))) as pool:
        return pool.map(inheritable_thread_target(work), items)


def logistic_regression(rows: int, seed: int, features=FEATURE_NAMES, iterations: int = 2000) -> Pipeline:
    """Multinomial, balanced, scaled. A penalty of 1 / rows on the mean loss is a unit penalty on the sum."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    model = LogisticRegression(
        family="multinomial", maxIter=iterations, tol=1e-4, regParam=1.0 / max(rows, 1), standardization=False,
        **COLUMNS,
    )
    return Pipeline(stages=[*preprocessing(features, "raw_features"), scaler, model])


def random_forest(rows: int, seed: int, features=FEATURE_NAMES, trees: int = 100, depth: int = 20) -> Pipeline:
    model = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, maxMemoryInMB=1024, **COLUMNS
    )
    return Pipeline(stages=[*preprocessing(features), model])


def boosted_trees(rows: int, seed: int, features=FEATURE_NAMES, rounds: int = 300, depth: int = 8) -> Pipeline:
    """A tree per class in each round, all classes under one softmax loss."""
    model = SoftmaxBoosting(classes=len(CLASSES), rounds=rounds, depth=depth, seed=seed, parallelism=AT_ONCE, **COLUMNS)
    return Pipeline(stages=[*preprocessing(features), model])


CANDIDATES = {
    "logistic_regression": logistic_regression,
    "random_forest": random_forest,
    "boosted_trees": boosted_trees,
}


def training_rows(divided: DataFrame, cap: int, seed: int, key: str = "capture_order") -> DataFrame:
    """Capped training rows with class index `y` and balanced `weight`."""
    train = cap_per_class(divided.filter("is_train"), cap, key, seed)
    return weighted(train.withColumn("y", class_index(F.col("label"))))


def weighted(train: DataFrame) -> DataFrame:
    weights = class_weights(train).select("label", "weight")
    return train.join(F.broadcast(weights), "label")  # one row per class


def fit(name: str, train: DataFrame, seed: int = 42, **params) -> PipelineModel:
    rows = train.count() if name == "logistic_regression" else 0
    return CANDIDATES[name](rows, seed, **params).fit(train)


def _one_vs_rest_proba() -> Column:
    """Margins of the boosted ensembles as probabilities that sum to one."""
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    return F.transform(each, lambda p: p / F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `proba` (an array) and `pred`, the first index of its maximum."""
    done = model.transform(rows)
    boosted = isinstance(model.stages[-1], OneVsRestModel)
    proba = _one_vs_rest_proba() if boosted else vector_to_array("probability")
    done = done.withColumn("proba", proba)
    best = F.array_position("proba", F.array_max("proba")).cast("int") - 1
    return done.withColumn("pred", best)


def cross_validate(name: str, train: DataFrame, seed: int = 42, **params) -> DataFrame:
    """Macro F1 per fold; each fold is scored by a model of the others."""
    folds = [r.fold for r in train.select("fold").distinct().orderBy("fold").collect()]

    def predicted(fold: int) -> DataFrame:
        rest = weighted(train.filter(F.col("fold") != fold).drop("weight"))
        model = fit(name, rest, seed, **params)
        return score(model, train.filter(F.col("fold") == fold)).select("fold", "y", "pred")

    return evaluate.fold_scores(reduce(DataFrame.unionByName, side_by_side(predicted, folds)), len(CLASSES))


def test_metrics(model: PipelineModel, test: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row of metrics on labelled flows: the test split, or another mapped dataset."""
    rows = score(model, test.withColumn("y", class_index(F.col("label")))).select("y", "pred", "proba").persist()
    ranked = evaluate.ranking_metrics(rows, blocks).agg(
        F.avg("roc_auc").alias("roc_auc_ovr_macro"), F.avg("average_precision").alias("pr_auc_macro")
    )
    return beside(evaluate.overall(evaluate.confusion(rows, len(CLASSES))), ranked)


def compare(
    divided: DataFrame, cap: int = 150_000, cv_cap: int = 20_000, seed: int = 42, params: dict | None = None
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Cross-validate, fit and evaluate each candidate. One row of results each, and the models."""
    params = params or {name: {} for name in CANDIDATES}
    train = cut_lineage(training_rows(divided, cap, seed))
    sample = cut_lineage(weighted(cap_per_class(train.drop("weight"), cv_cap, "capture_order", seed)))
    test = divided.filter(~F.col("is_train"))
    rows, models = [], {}
    for name, given in params.items():
        summary = evaluate.fold_summary(cross_validate(name, sample, seed, **given))
        models[name] = fit(name, train, seed, **given)
        cv = summary.select(
            F.lit(name).alias("candidate"), F.col("mean").alias("cv_macro_f1_mean"), F.col("std").alias("cv_macro_f1_std")
        )
        rows.append(beside(cv, test_metrics(models[name], test)))
    return reduce(DataFrame.unionByName, rows), models


def best(results: DataFrame) -> str:
    return results.agg(F.max_by("candidate", "cv_macro_f1_mean")).first()[0]


# Binary models on connection records


def split_records(records: DataFrame, test_share: float = 0.1, seed: int = 43) -> list[DataFrame]:
    return records.randomSplit([1 - test_share, test_share], seed)


def record_pipeline(kind: str, seed: int = 42, rounds: int = 128) -> Pipeline:
    """Scaled connection features into a boosted or a logistic model; label 1 is attack."""
    assemble = VectorAssembler(inputCols=list(CONNECTION_FEATURES), outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    if kind == "boosted":
        model = GBTClassifier(
            labelCol="y", maxIter=rounds, maxDepth=6, stepSize=0.1, subsamplingRate=0.8,
            featureSubsetStrategy="0.5", seed=seed, maxMemoryInMB=1024,
        )
    else:
        model = LogisticRegression(labelCol="y", maxIter=1000)
    return Pipeline(stages=[assemble, scale, model])


def score_records(model: PipelineModel, records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Attack confidence and label; absent or empty features count as 0."""
    given = set(records.columns)
    filled = records.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in given else F.lit(0.0) for c in CONNECTION_FEATURES}
    )
    done = model.transform(filled).withColumn("confidence", vector_to_array("probability")[1])
    return done.withColumn("label", F.when(F.col("confidence") >= threshold, "ATTACK").otherwise("NORMAL"))


