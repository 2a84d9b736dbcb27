"""Why a flow was classified as it was: signed attributions per feature.

Linear models: coefficient times distance from the background mean, in plain column expressions.
Tree models: exact Shapley values of the path-dependent game, in Arrow batches next to the data. They
add up to the class's share of votes in a forest, and to its margin in boosted ensembles, less the
value an unknown flow would get.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from flowloom.plans import boosting
from flowloom.registry import CLASSES, FEATURE_NAMES
from flowloom.session import scratch_path


def linear_contributions(model: PipelineModel, background: DataFrame, class_id: Column) -> Column:
    """Contribution of each feature towards a class, for rows the pipeline has transformed."""
    mean = model.transform(background).agg(Summarizer.mean(F.col("features"))).first()[0].toArray()
    classes = model.stages[-1].coefficientMatrix.toArray()
    number = lambda v: F.lit(float(v))
    table = F.array(*[F.array(*[number(v) for v in row]) for row in classes])
    centre = F.array(*[number(v) for v in mean])
    distance = F.zip_with(vector_to_array("features"), centre, lambda x, m: x - m)
    return F.zip_with(distance, F.get(table, class_id), lambda x, c: x * c)


MAX_NODES = 500_000  # nodes of trees sent to the executors together


def tree_nodes(spark: SparkSession, forest) -> DataFrame:
    """Node table of a fitted ensemble: (tree, node, feature, threshold, left, right, stats, prediction)."""
    path = scratch_path(spark, "forest")
    forest.write().save(path)
    n = spark.read.parquet(f"{path}/data")
    # the node struct's name differs between Spark versions
    node = "nodeData" if "nodeData" in n.columns else n.columns[-1]
    tree = n.columns[0]
    return n.select(
        F.col(tree).alias("tree"),
        F.col(f"{node}.id").alias("node"),
        F.col(f"{node}.split.featureIndex").alias("feature"),
        F.col(f"{node}.split.leftCategoriesOrThreshold").alias("threshold"),
        F.col(f"{node}.leftChild").alias("left"),
        F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{node}.impurityStats").alias("stats"),
        F.col(f"{node}.prediction").alias("prediction"),
        F.col(f"{node}.rawCount").alias("rows"),
    )


def tree_groups(nodes: DataFrame, limit: int) -> list[list[int]]:
    """Trees packed into groups of at most `limit` nodes; a larger tree is a group of its own."""
    groups, size = [], limit
    for row in nodes.groupBy("tree").count().orderBy("tree").collect():  # a row per tree
        if size + row["count"] > limit:
            groups.append([])
            size = 0
        groups[-1].append(row["tree"])
        size += row["count"]
    return groups


def leaves_of(nodes: pd.DataFrame, value, cover_of) -> list[tuple]:
    """Every leaf as (features on its path, lower and upper bounds, cover shares, value per class).

    Bounds and shares of a feature met twice are merged. `value` gives a leaf's array of values and
    `cover_of` the weight of the training rows at a node.
    """
    found = []
    for _, part in nodes.groupby("tree"):
        at = {int(r.node): r for r in part.itertuples(index=False)}
        cover = {i: cover_of(r) for i, r in at.items()}
        stack = [(0, {})]
        while stack:
            i, path = stack.pop()
            row = at[i]
            if row.left < 0:
                features = sorted(path)
                lo, hi, share = np.array([path[f] for f in features]).reshape(-1, 3).T
                found.append((np.array(features, dtype=int), lo, hi, share, value(row)))
                continue
            f, cut = int(row.feature), float(row.threshold[0])
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            left, right = int(row.left), int(row.right)
            stack.append((left, path | {f: (lo, min(hi, cut), share * cover[left] / cover[i])}))
            stack.append((right, path | {f: (max(lo, cut), hi, share * cover[right] / cover[i])}))
    return found


def ensembles(model, limit: int):
    """The groups of leaves of a fitted ensemble, a forest or boosted trees per class."""
    spark = SparkSession.getActiveSession()
    if isinstance(model, boosting.SoftmaxBoostingModel):
        nodes = spark.createDataFrame(model.nodes, boosting.NODES).withColumn("threshold", F.array("threshold"))

        def share(row):
            value = np.zeros(model.classes)
            value[int(row.class_id)] = row.prediction
            return value

        for group in tree_groups(nodes, limit):
            part = nodes.filter(F.col("tree").isin(group)).toPandas()
            yield leaves_of(part, share, lambda r: float(r.rows))
        return
    if isinstance(model, OneVsRestModel):
        classes = len(model.models)
        for c, boosted in enumerate(model.models):
            nodes, weights = tree_nodes(spark, boosted), list(boosted.treeWeights)

            def margin(row, c=c, weights=weights):
                value = np.zeros(classes)
                value[c] = weights[int(row.tree)] * row.prediction
                return value

            for group in tree_groups(nodes, limit):
                part = nodes.filter(F.col("tree").isin(group)).toPandas()
                yield leaves_of(part, margin, lambda r: float(r.rows))
        return
    nodes = tree_nodes(spark, model)

    def votes(row):
        stats = np.asarray(row.stats)
        return stats / stats.sum() / model.getNumTrees

    for group in tree_groups(nodes, limit):
        part = nodes.filter(F.col("tree").isin(group)).toPandas()
        yield leaves_of(part, votes, lambda r: float(np.sum(r.stats)))


def path_attributions(leaves: list[tuple], x: np.ndarray, class_id: np.ndarray | None = None) -> np.ndarray:
    """Shapley values (rows, features) towards each row's class, or (rows, classes, features) of all.

    In a leaf's game a feature contributes 1 or 0 when known (does the row stay on the path) and the
    cover share when not. Its Shapley value is (known - share) times the integral over t in (0, 1) of
    the product of share * (1 - t) + known * t over the other features: a polynomial, so a Gauss rule
    with enough points gives it exactly.
    """
    classes = len(leaves[0][4]) if leaves else 0
    out = np.zeros_like(x) if class_id is not None else np.zeros((len(x), classes, x.shape[1]))
    rules = {}
    for features, lo, hi, share, value in leaves:
        d = len(features)
        if d == 0 or not value.any():
            continue
        q = d // 2 + 1
        if q not in rules:
            points, weights = np.polynomial.legendre.leggauss(q)
            rules[q] = ((points + 1) / 2, weights / 2)
        t, w = rules[q]
        cells = x[:, features]
        known = ((cells > lo) & (cells <= hi)).astype(float)
        each = share[None, :, None] * (1 - t) + known[:, :, None] * t
        others = (each.prod(axis=1, keepdims=True) / each) @ w
        moved = (known - share) * others
        if class_id is not None:
            out[:, features] += moved * value[class_id][:, None]
        else:
            for c in np.flatnonzero(value):
                out[:, c, features] += moved * value[c]
    return out


def _attribution_udf(leaves):
    @F.pandas_udf(ArrayType(DoubleType()))
    def attribute(x: pd.Series, c: pd.Series) -> pd.Series:
        result = [None] * len(x)
        rows = np.flatnonzero((x.notna() & c.notna()).to_numpy())
        if len(rows):
            flows, towards = np.stack(x.iloc[rows].to_numpy()), c.iloc[rows].to_numpy(dtype=int)
            for i, values in zip(rows, path_attributions(leaves.value, flows, towards)):
                result[i] = values
        return pd.Series(result, dtype="object")

    return attribute


def tree_contributions(model: PipelineModel, class_id: Column, wanted: Column, limit: int = MAX_NODES) -> Column:
    """Attributions towards a class where `wanted` holds, null elsewhere.

    Attributions of trees add up, so an ensemble goes out in groups of counted size, each with a
    column of its own, and the columns are summed. Rows not wanted cross to Python as nulls only.
    """
    spark = SparkSession.getActiveSession()
    flows, towards = F.when(wanted, vector_to_array("features")), F.when(wanted, class_id)
    groups = ensembles(model.stages[-1], limit)
    parts = [_attribution_udf(spark.sparkContext.broadcast(leaves))(flows, towards) for leaves in groups]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def _all_classes_udf(leaves):
    @F.pandas_udf(ArrayType(DoubleType()))
    def attribute(x: pd.Series) -> pd.Series:
        flows = np.stack(x.to_numpy())
        return pd.Series(list(path_attributions(leaves.value, flows).reshape(len(flows), -1)), dtype="object")

    return attribute


def all_contributions(model: PipelineModel, background: DataFrame, limit: int = MAX_NODES) -> Column:
    """Attributions towards every class in one pass: classes times features in one array, class by class."""
    last = model.stages[-1]
    if hasattr(last, "coefficientMatrix"):
        classes = F.array(*[F.lit(c) for c in range(last.numClasses)])
        return F.flatten(F.transform(classes, lambda c: linear_contributions(model, background, c)))
    spark = background.sparkSession
    flows = vector_to_array("features")
    parts = [_all_classes_udf(spark.sparkContext.broadcast(x))(flows) for x in ensembles(last, limit)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def contributions(model: PipelineModel, background: DataFrame, class_id: Column, wanted: Column) -> Column:
    """The attribution column that fits the model's last stage."""
    if hasattr(model.stages[-1], "coefficientMatrix"):
        return F.when(wanted, linear_contributions(model, background, class_id))
    return tree_contributions(model, class_id, wanted)


def top_features(parts: Column, names=FEATURE_NAMES, k: int = 5) -> Column:
    """The k strongest pushes towards the class: feature, value, contribution, share in percent."""
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.abs(x))
    share = lambda c: F.round(F.abs(c) / F.when(total > 0, total).otherwise(1.0) * 100, 2)
    labels, values = F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
    items = F.transform(
        parts,
        lambda c, i: F.struct(
            (-c).alias("order"),
            i.alias("i"),
            F.get(labels, i).alias("feature"),
            F.get(values, i).alias("value"),
            c.alias("contribution"),
            share(c).alias("weight"),
        ),
    )
    pushing = F.filter(F.slice(F.array_sort(items), 1, k), lambda s: s["contribution"] > 0)
    return F.transform(pushing, lambda s: F.struct(s["feature"], s["value"], s["contribution"], s["weight"]))


def global_importance(
    model: PipelineModel, sample: DataFrame, background: DataFrame, names=FEATURE_NAMES
) -> DataFrame:
    """Mean absolute attribution per feature, summed over the classes."""
    rows = model.transform(sample).withColumn("parts", all_contributions(model, background))
    pairs = rows.select(F.posexplode("parts").alias("at", "part"))
    classes = F.max(F.floor(F.col("at") / len(names))) + 1
    mean = F.sum(F.abs("part")) * classes / F.count("*")
    sums = pairs.groupBy((F.col("at") % len(names)).cast("int").alias("i")).agg(mean.alias("importance"))
    labels = F.array(*[F.lit(n) for n in names])
    return sums.select(F.get(labels, F.col("i")).alias("feature"), "importance").orderBy(F.desc("importance"))
