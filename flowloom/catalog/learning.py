"""Queries that train and apply models on flows derived from the events table.

Models have no SQL equivalent, so most of these are checked by tests instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.catalog.flows import divided
from flowloom.catalog.traffic import RECORDS, connections
from flowloom.operators import evaluate, records
from flowloom.operators.split import stratified_sample
from flowloom.plans import bundle, explain, models, run, scoring
from flowloom.registry import CLASSES
from flowloom.session import cut_lineage, scratch_path, stored


def prepared(spark, d):
    """Split flows and capped training rows: read by every fold and model, so written once."""
    flows = cut_lineage(divided(spark, d))
    return flows, cut_lineage(models.training_rows(flows, 150_000, 42))


def _metrics(spark, d, name, **params):
    flows, train = prepared(spark, d)
    model = models.fit(name, train, **params)
    return models.test_metrics(model, flows.filter("not is_train"))


@register()
def logistic_regression_metrics(spark, d):
    return _metrics(spark, d, "logistic_regression")


@register()
def random_forest_metrics(spark, d):
    return _metrics(spark, d, "random_forest")


@register()
def boosted_trees_metrics(spark, d):
    """Five rounds of depth 4 per class; the defaults are 300 of depth 8."""
    return _metrics(spark, d, "boosted_trees", rounds=5, depth=4)


@register()
def cross_validation(spark, d):
    _, train = prepared(spark, d)
    return models.cross_validate("random_forest", train, trees=10, depth=8)


@register()
def model_comparison(spark, d):
    """All candidates at the library's sizes."""
    flows, _ = prepared(spark, d)
    return models.compare(flows, cv_cap=20_000)[0]


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        """select candidate, count(case when is_train then 1 end) as train_rows_used, count(case when not is_train then 1 end) as test_rows,
  count(distinct case when is_train then fold end) as folds, 0 as metrics_off, 0 as unpublished
from split, (select unnest(['logistic_regression', 'random_forest', 'boosted_trees']) as candidate) group by 1""",
    )
)
def training_run(spark, d):
    """A published run of all candidates, read back: rows used, rows scored, folds, and what differs from
    metrics worked out anew from the published predictions (nothing). Eighteen models are fitted, at the
    library's sizes."""
    flows = stored(divided(spark, d), "split-flows")
    done = run.training_run(flows, scratch_path(spark, "models"))
    predictions, comparison, folds = (done.read(n) for n in ("predictions", "comparison", "cv_scores"))
    hit = F.avg((F.col("y") == F.col("pred")).cast("double"))
    flagged = F.avg(F.when(F.col("y") != 0, (F.col("pred") != 0).cast("double")))
    again = predictions.groupBy("candidate").agg(F.count("*").alias("test_rows"), hit.alias("hit"), flagged.alias("flagged"))
    off = (F.abs(F.col("hit") - F.col("accuracy")) > 1e-9) | (F.abs(F.col("flagged") - F.col("attack_detection_rate")) > 1e-9)
    counted = folds.groupBy("candidate").agg(F.count("*").alias("folds"))
    return again.join(comparison, "candidate").join(counted, "candidate").select(
        "candidate",
        F.lit(done.metadata["train_rows_used"]).cast("long").alias("train_rows_used"),
        "test_rows",
        "folds",
        off.cast("int").alias("metrics_off"),
        F.lit(0 if bundle.load_bundle(spark, f"{done.path}/bundle").metadata["selected"] == done.metadata["selected"] else 1).alias("unpublished"),
    )


@register()
def feature_ablation(spark, d):
    """Metrics without the two TCP window features."""
    left = [f for f in models.FEATURE_NAMES if not f.startswith("init_win_bytes")]
    return _metrics(spark, d, "random_forest", features=left, trees=10, depth=8)


@register()
def scored_flows(spark, d):
    """Predictions of a saved and reloaded model, attacks explained."""
    flows, train = prepared(spark, d)
    background = stratified_sample(train, 200, len(CLASSES), "capture_order", 42)
    model = models.fit("logistic_regression", train)
    path = bundle.save_bundle(model, background, scratch_path(spark, "bundle"), {"candidate": "logistic_regression"})
    loaded = bundle.load_bundle(spark, path)
    done = scoring.predict(loaded.model, flows.filter("not is_train").drop("label"), loaded.background)
    return done.select("capture_order", "label", "confidence", "class_probs", "is_attack", "summary", "explanation")


@register()
def tree_explanations(spark, d):
    flows, train = prepared(spark, d)
    model = models.fit("random_forest", train, trees=20, depth=8)
    done = scoring.predict(model, flows.filter("not is_train").drop("label"), train)
    return done.select("capture_order", "label", "confidence", "explanation")


@register()
def feature_importance(spark, d):
    flows, train = prepared(spark, d)
    model = models.fit("random_forest", train, trees=20, depth=8)
    sample = stratified_sample(flows.filter("not is_train"), 2000, len(CLASSES), "capture_order", 42)
    return explain.global_importance(model, sample, train).limit(15)


@register()
def connection_models(spark, d):
    """Boosted and logistic models on connection records: a binary report each."""
    coded, _ = records.encode_records(records.clean_records(connections(spark, d)))
    rows = coded.withColumn("y", 1 - F.col("attack").cast("int")).persist()  # attack sorts before normal
    train, test = models.split_records(rows)
    reports = []
    for kind in ("boosted", "logistic"):
        model = models.record_pipeline(kind, rounds=20).fit(train)
        done = model.transform(test).select(
            "y", F.col("prediction").cast("int").alias("pred"), models.vector_to_array("probability").alias("proba")
        )
        reports.append(evaluate.binary_report(done).withColumn("model", F.lit(kind)))
    return reduce(DataFrame.unionByName, reports)


@register(
    q.query(
        [RECORDS],
        """select case when attack = 'normal' then 'normal' else 'attack' end as attack, count(*) as records, 0 as absent_off,
  0 as label_off from (select distinct * from records) group by 1""",
    )
)
def record_scores(spark, d):
    """All connection records scored by a model of them: how many, how many of them score otherwise when
    features are absent than when they are 0, and whose label does not fit the confidence (none)."""
    cleaned = records.clean_records(connections(spark, d)).withColumn("kind", F.col("attack"))
    coded, _ = records.encode_records(cleaned)
    coded = stored(coded.withColumn("_id", F.xxhash64(*cleaned.columns)), "coded-records")
    model = models.record_pipeline("logistic").fit(coded.withColumn("y", 1 - F.col("attack").cast("int")))
    live = coded.drop("src_bytes", "count")
    zero = coded.withColumns({"src_bytes": F.lit(0.0), "count": F.lit(None).cast("double")})
    scored = [models.score_records(model, x).select("_id", "kind", "confidence", "label") for x in (live, zero)]
    told = (F.col("confidence") >= 0.5) != (F.col("label") == "ATTACK")
    both = scored[0].unionByName(scored[1]).groupBy("_id", "kind").agg(
        (F.count("*") / 2).alias("n"), (F.max("confidence") - F.min("confidence")).alias("apart"), F.max(told.cast("int")).alias("told")
    )
    off = F.sum(F.when(F.col("apart") > 1e-9, 1).otherwise(0))
    return both.groupBy(F.col("kind").alias("attack")).agg(
        F.sum("n").cast("long").alias("records"), off.cast("int").alias("absent_off"), F.sum("told").cast("int").alias("label_off")
    )


@register(
    q.query(
        [q.SCORED],
        """select event_id, case pred when 0 then 'benign' when 1 then 'ddos' when 2 then 'dos' when 3 then 'portscan' else 'bruteforce' end
    as label, round(greatest(p0, p1, p2, p3, p4), 4) as confidence, pred <> 0 as is_attack, round(p0, 4) as p_benign from scored""",
    )
)
def prediction_rows(spark, d):
    parts = scoring.prediction_columns(F.col("proba"))
    rows = fx.scored(spark, d).withColumns(parts)
    return rows.select("event_id", "label", "confidence", "is_attack", F.col("class_probs")["benign"].alias("p_benign"))
