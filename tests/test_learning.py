"""Metrics against brute force; models on the generated flow files."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.catalog import learning
from flowloom.functions.flows import class_index
from flowloom.operators import clean, evaluate, split
from flowloom.plans import boosting, bundle, explain, models, scoring
from flowloom.registry import CLASSES, FEATURE_NAMES
from flowloom.session import cut_lineage
from flowloom.sources import flows


def auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(s, y) for b, j in zip(s, y) if i and not j]
    return sum(pairs) / len(pairs)


def average_precision(y, s):
    total, last = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        hits = [i for i, v in zip(y, s) if v >= cut]
        recall = sum(hits) / sum(y)
        total, last = total + (recall - last) * sum(hits) / len(hits), recall
    return total


@pytest.mark.parametrize("blocks", [3, 64])
def test_ranking_metrics_with_ties(spark, blocks):
    random.seed(4)
    rows = []
    for _ in range(200):
        p = [random.randint(1, 5) for _ in range(3)]
        rows.append((random.choice([0, 0, 1, 2]), [v / sum(p) for v in p]))
    df = spark.createDataFrame(rows, "y int, proba array<double>")
    got = {r.class_id: r for r in evaluate.ranking_metrics(df, blocks).collect()}
    for c in range(3):
        y, s = [r[0] == c for r in rows], [r[1][c] for r in rows]
        assert got[c].roc_auc == pytest.approx(auc(y, s))
        assert got[c].average_precision == pytest.approx(average_precision(y, s))


def test_absent_and_only_classes(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1]), (0, 1, [0.2, 0.8])], "y int, pred int, proba array<double>")
    got = {r.class_id: r for r in evaluate.ranking_metrics(df).collect()}
    assert (got[0].roc_auc, got[0].average_precision, got[1].average_precision) == (None, 1.0, None)
    row = evaluate.overall(evaluate.confusion(df, 2)).first()
    assert (row.accuracy, row.attack_detection_rate, row.false_positive_rate) == (0.5, 0.0, 0.5)


@pytest.fixture(scope="module")
def prepared(spark, flow_dir):
    kept = clean.clean(flows.read_flow_csvs(spark, flow_dir), flows.CSV_ORDER)
    divided = split.temporal_split(kept, flows.CSV_ORDER, block="file_block_start")
    divided = cut_lineage(divided.withColumn("capture_order", F.xxhash64("source_file", "file_block_start", "row_id")))
    train = models.training_rows(divided, 500, 42)
    return divided, cut_lineage(train)


@pytest.fixture(scope="module")
def fitted(prepared):
    return {
        "linear": models.fit("logistic_regression", prepared[1], iterations=100),
        "forest": models.fit("random_forest", prepared[1], trees=5, depth=5),
        "boosted": models.fit("boosted_trees", prepared[1], rounds=2, depth=3),
    }


@pytest.mark.parametrize("kind", ["linear", "forest"])
def test_models_learn(prepared, fitted, kind):
    row = models.test_metrics(fitted[kind], prepared[0].filter("not is_train")).first()
    assert row.macro_f1 > 0.9 and row.roc_auc_ovr_macro > 0.9


def test_boosted_trees_learn(prepared):
    divided, train = prepared
    few = train.filter(F.col("label").isin("benign", "ddos", "dos")).withColumn("y", class_index(F.col("label")))
    model = models.fit("boosted_trees", few, rounds=3, depth=3)
    done = models.score(model, divided.filter("not is_train and label in ('benign', 'ddos', 'dos')"))
    sums = done.select(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("s"), "pred", "label").collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    assert np.mean([CLASSES[r.pred] == r.label for r in sums]) > 0.9


def test_cross_validation_and_selection(prepared):
    scores = models.cross_validate("random_forest", prepared[1], trees=3, depth=5)
    assert scores.count() == 5
    results, found = models.compare(prepared[0], 200, 100, params={"random_forest": {"trees": 3, "depth": 5}})
    assert models.best(results) == "random_forest" and set(found) == {"random_forest"}


def brute_shapley(leaves, x, c):
    """Shapley values by summing over all coalitions of the features the trees use."""
    used = sorted({f for leaf in leaves for f in leaf[0]})

    def worth(known):
        total = 0.0
        for features, lo, hi, share, value in leaves:
            part = value[c]
            for f, a, b, s in zip(features, lo, hi, share):
                part *= (a < x[f] <= b) if f in known else s
            total += part
        return total

    out, d = np.zeros(len(x)), len(used)
    for f in used:
        rest = [g for g in used if g != f]
        for k in range(d):
            for chosen in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                out[f] += weight * (worth({*chosen, f}) - worth({*chosen}))
    return out


def test_tree_attributions(spark, prepared):
    model = models.fit("random_forest", prepared[1], trees=2, depth=3)
    (leaves,) = explain.ensembles(model.stages[-1], explain.MAX_NODES)
    rows = models.score(model, prepared[0].limit(20)).select("features", "proba", "pred").collect()
    x, c = np.stack([r.features.toArray() for r in rows]), np.array([r.pred for r in rows])
    got = explain.path_attributions(leaves, x, c)
    for i in range(4):
        assert got[i] == pytest.approx(brute_shapley(leaves, x[i], c[i]))
    done = models.score(model, prepared[0].limit(20))
    apart = explain.tree_contributions(model, F.col("pred"), F.lit(True), limit=1)  # a group per tree
    assert np.array([r[0] for r in done.select(apart).collect()]) == pytest.approx(got)
    base = sum(np.prod(share) * value for _, _, _, share, value in leaves)
    assert got.sum(axis=1) + base[c] == pytest.approx([r.proba[r.pred] for r in rows])


def test_boosted_attributions_add_up_to_the_margin(prepared, fitted):
    model = fitted["boosted"]
    leaves = [leaf for group in explain.ensembles(model.stages[-1], explain.MAX_NODES) for leaf in group]
    done = models.score(model, prepared[0].limit(20))
    parts = explain.contributions(model, prepared[1], F.col("pred"), F.lit(True))
    rows = done.select("features", "rawPrediction", "pred", parts.alias("p")).collect()
    base = sum(np.prod(share) * value for _, _, _, share, value in leaves)
    for r in rows:
        assert sum(r.p) + base[r.pred] == pytest.approx(r.rawPrediction[r.pred])


def test_all_classes_in_one_pass(prepared, fitted):
    for model in (fitted["boosted"], fitted["forest"], fitted["linear"]):
        done = models.score(model, prepared[0].limit(10))
        one = explain.contributions(model, prepared[1], F.col("pred"), F.lit(True))
        every = explain.all_contributions(model, prepared[1])
        for r in done.select("pred", one.alias("one"), every.alias("every")).collect():
            at = r.pred * len(FEATURE_NAMES)
            assert r.every[at : at + len(FEATURE_NAMES)] == pytest.approx(r.one)


def test_linear_attributions(prepared, fitted):
    background = prepared[1]
    done = models.score(fitted["linear"], prepared[0].limit(50))
    parts = explain.linear_contributions(fitted["linear"], background, F.col("pred"))
    stage = fitted["linear"].stages[-1]
    rows = done.select(parts.alias("p"), "rawPrediction", "pred").collect()
    mean = np.mean([r[0].toArray() for r in fitted["linear"].transform(background).select("features").collect()], axis=0)
    base = stage.coefficientMatrix.toArray() @ mean + stage.interceptVector.toArray()
    for r in rows:
        assert sum(r.p) + base[r.pred] == pytest.approx(r.rawPrediction[r.pred])


@pytest.mark.parametrize("kind", ["linear", "forest", "boosted"])
def test_predictions_and_explanations(prepared, fitted, kind):
    divided, train = prepared
    test = divided.filter("not is_train").drop("label").limit(60)
    done = scoring.predict(fitted[kind], test, train).collect()
    assert any(r.is_attack for r in done) and any(not r.is_attack for r in done)
    for r in done:
        assert (len(r.explanation) > 0) == r.is_attack and len(r.explanation) <= 5
        assert r.confidence == max(r.class_probs.values())
        assert all(e.contribution > 0 and e.value == r[e.feature] for e in r.explanation)
        assert [e.contribution for e in r.explanation] == sorted((e.contribution for e in r.explanation), reverse=True)
        assert sum(e.weight for e in r.explanation) <= 100.05
    assert all(not r.explanation for r in scoring.predict(fitted[kind], test, train, explain="none").collect())
    with pytest.raises(ValueError):
        scoring.predict(fitted[kind], test, train, explain="some")


def test_global_importance(prepared, fitted):
    rows = explain.global_importance(fitted["forest"], prepared[0].limit(50), prepared[1]).collect()
    assert len(rows) == len(FEATURE_NAMES) and rows[0].importance > 0


def test_bundle(spark, prepared, fitted, tmp_path):
    path = bundle.save_bundle(fitted["linear"], prepared[1].limit(20), str(tmp_path / "b"), {"candidate": "x"})
    found = bundle.load_bundle(spark, path)
    assert found.metadata == {"candidate": "x"} and found.background.count() == 20
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, path, FEATURE_NAMES[:-1])
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, str(tmp_path / "none"))
    prepared[1].limit(3).select(*FEATURE_NAMES).write.mode("append").parquet(f"{path}/background")
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, path)


def test_comparison_has_all_candidates_at_full_size(monkeypatch):
    asked = []

    def compare(flows, cap=150_000, cv_cap=20_000, seed=42, params=None):
        asked.append(params)
        return [None]

    monkeypatch.setattr(learning, "prepared", lambda spark, d: (None, None))
    monkeypatch.setattr(learning.models, "compare", compare)
    learning.model_comparison(None, None)
    assert asked == [None]


def brute_tree(x, g, h, depth):
    """Values of the rows under the tree that the best splits of all thresholds give."""
    rows = np.arange(len(x))
    value = np.full(len(x), -g.sum() / (h.sum() + 1))
    if not depth:
        return value
    worth = lambda some: g[some].sum() ** 2 / (h[some].sum() + 1)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for v in sorted(set(x[:, f]))[:-1]:
            sides = rows[x[:, f] <= v], rows[x[:, f] > v]
            if min(h[s].sum() for s in sides) >= 1:
                best = max(best, (worth(sides[0]) + worth(sides[1]) - worth(rows), f, v), key=lambda b: b[0])
    if best[1] is not None:
        left = x[:, best[1]] <= best[2]
        for side in (left, ~left):
            value[side] = brute_tree(x[side], g[side], h[side], depth - 1)
    return value


def test_softmax_boosting_equals_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (150, 4)).astype("float32")
    y, w = (x[:, 0] + x[:, 1] > 8).astype(int) + (x[:, 2] > 5), rng.uniform(0.5, 2, 150)
    shuffled = rng.permutation(150)
    options = dict(classes=3, rounds=4, depth=3, rate=0.3, share=1.0, feature_share=1.0, seed=1)
    nodes = boosting.boost(*boosting.binned(x, y, w), **options)
    again = boosting.boost(*boosting.binned(x[shuffled], y[shuffled], w[shuffled]), **options, threads=3)
    assert nodes.equals(again)
    margins = np.zeros((150, 3))
    for _ in range(4):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        for c in range(3):
            g, h = (p[:, c] - (y == c)) * w, 2 * p[:, c] * (1 - p[:, c]) * w
            margins[:, c] += 0.3 * brute_tree(x, g, h, 3)
    assert boosting.margins_of(boosting.packed(nodes, 3), x) == pytest.approx(margins)


def test_cut_points_of_many_values():
    values = np.random.default_rng(2).normal(size=5000).astype("float32")
    cuts = boosting.cut_points(values)
    sizes = np.bincount(np.searchsorted(cuts, values))
    assert len(sizes) == boosting.BINS and sizes.max() < 2 * 5000 / boosting.BINS
    assert list(boosting.cut_points(np.array([1, 1, 4, 2], dtype="float32"))) == [1.5, 3.0]


def test_boosted_trees_fit_every_class_in_each_round(spark, prepared, fitted, tmp_path):
    model = fitted["boosted"]
    trees = model.stages[-1].nodes.drop_duplicates("tree")
    assert trees["class_id"].tolist() == [*range(len(CLASSES))] * 2
    model.write().save(f"{tmp_path}/model")
    rows = prepared[0].limit(20)
    kept = models.score(models.PipelineModel.load(f"{tmp_path}/model"), rows).select("proba", "pred").collect()
    found = models.score(model, rows).select("proba", "pred", "rawPrediction").collect()
    assert kept == [(r.proba, r.pred) for r in found]
    for r in found:
        assert r.proba == pytest.approx(boosting.softmax(r.rawPrediction.toArray()[None])[0])


def test_training_run_fits_all_candidates_at_full_size(monkeypatch):
    asked = []

    def training_run(flows, root, **options):
        asked.append(options)
        raise InterruptedError

    for name in ("divided", "stored", "scratch_path"):
        monkeypatch.setattr(learning, name, lambda *_: None)
    monkeypatch.setattr(learning.run, "training_run", training_run)
    with pytest.raises(InterruptedError):
        learning.training_run(None, None)
    assert asked == [{}]
