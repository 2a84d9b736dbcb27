"""A whole training run: candidates compared, one selected, everything published as one version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.flows import class_index
from flowloom.operators import evaluate
from flowloom.operators.scan import beside
from flowloom.operators.split import cap_per_class, stratified_sample
from flowloom.plans import bundle, explain, models
from flowloom.plans.publish import Published, begin, open_version
from flowloom.plans.training import class_counts
from flowloom.registry import CLASSES, FEATURE_NAMES
from flowloom.session import stored

#: Rows (over all classes) of the background and of the sample that importance is averaged over.
BACKGROUND_ROWS, IMPORTANCE_ROWS = 200, 2000


def evaluated(predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row of test metrics, the metrics per class, and the confusion counts of `predictions`."""
    confused = evaluate.confusion(predictions, len(CLASSES))
    ranked = evaluate.ranking_metrics(predictions)
    macro = ranked.agg(F.avg("roc_auc").alias("roc_auc_ovr_macro"), F.avg("average_precision").alias("pr_auc_macro"))
    names = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class_id") + 1)
    each = evaluate.per_class(confused).join(ranked, "class_id", "left").withColumn("label", names)
    return beside(evaluate.overall(confused), macro), each, confused


def training_run(
    divided: DataFrame,
    root: str,
    cap: int = 150_000,
    cv_cap: int = 20_000,
    seed: int = 42,
    params: dict | None = None,
    key: str = "capture_order",
    metadata: dict | None = None,
    day: str | None = None,
) -> Published:
    """Cross-validate, fit and test the candidates on split flows, and publish under `root`:

    class_counts, cv_scores (a row per candidate and fold), predictions (of every test flow by every
    candidate), comparison (a row per candidate), per_class, confusion, importance of the selected
    candidate, and its bundle. The candidate with the best mean macro F1 over the folds is selected.
    Metrics come from the written predictions, so each model scores the test flows once.
    """
    spark = divided.sparkSession
    params = params or {name: {} for name in models.CANDIDATES}
    draft = begin(spark, root, day)
    train = stored(models.training_rows(divided, cap, seed, key), "training-rows")
    sample = stored(models.weighted(cap_per_class(train.drop("weight"), cv_cap, key, seed)), "fold-rows")
    test = divided.filter(~F.col("is_train")).withColumn("y", class_index(F.col("label")))
    counts = draft.write(class_counts(divided), "class_counts")
    folds, results, each, confused, found, fitted = [], [], [], [], [], {}
    for name, given in params.items():
        named = lambda df, name=name: df.select(F.lit(name).alias("candidate"), "*")
        scores = stored(models.cross_validate(name, sample, seed, **given), "fold-scores")
        fitted[name] = models.fit(name, train, seed, **given)
        done = models.score(fitted[name], test).select(key, "y", "pred", "proba")
        done = stored(done, "predictions")
        metrics, per_class, confusion = evaluated(done)
        summary = evaluate.fold_summary(scores).select(F.col("mean").alias("cv_macro_f1_mean"), F.col("std").alias("cv_macro_f1_std"))
        folds.append(named(scores))
        found.append(named(done))
        results.append(named(beside(summary, metrics)))
        each.append(named(per_class))
        confused.append(named(confusion))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    draft.write(union(folds), "cv_scores")
    draft.write(union(found), "predictions")
    draft.write(union(each), "per_class")
    draft.write(union(confused), "confusion")
    comparison = draft.write(union(results), "comparison")
    selected = models.best(comparison)
    background = stratified_sample(train, BACKGROUND_ROWS, len(CLASSES), key, seed)
    used = stratified_sample(test, IMPORTANCE_ROWS, len(CLASSES), key, seed)
    features = params[selected].get("features", FEATURE_NAMES)
    draft.write(explain.global_importance(fitted[selected], used, background, features), "importance")
    rows = {r["label"]: {"train": r["train"], "test": r["test"]} for r in counts.collect()}  # a row per class
    about = {
        "selected": selected, "seed": seed, "cap_per_class": cap, "cv_cap_per_class": cv_cap, "train_rows_used": train.count(),
        "classes": rows, "features": list(features), "params": {n: {k: str(v) for k, v in p.items()} for n, p in params.items()},
        "selection": "highest mean macro F1 over the folds of the training split", **(metadata or {}),
    }
    bundle.save_bundle(fitted[selected], background, f"{draft.path}/bundle", about, features)
    return open_version(spark, root, draft.publish(about))
