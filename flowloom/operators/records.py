"""Connection records: cleaning, encoding, mutual information and feature choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.scan import Measure, running
from flowloom.registry import CONNECTION_TEXT
from flowloom.session import stored


def clean_records(records: DataFrame) -> DataFrame:
    """Distinct rows with the attack name reduced to normal or attack."""
    kind = F.when(F.col("attack") == "normal", "normal").otherwise("attack")
    return records.dropDuplicates().withColumn("attack", kind)


def encode_records(records: DataFrame, columns=CONNECTION_TEXT):
    """Text columns become codes in sorted order, one indexer per column. Returns (frame, model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    stages = [
        StringIndexer(inputCol=c, outputCol=f"_{c}", stringOrderType="alphabetAsc") for c in columns
    ]
    model = Pipeline(stages=stages).fit(records)
    coded = model.transform(records)
    return coded.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns]), model


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature with the label, over equal-width bins.

    One pass finds the ranges, a second counts (feature, bin, label); everything after that works
    on the contingency table, whose size depends on features, bins and labels only.
    """
    ends = df.agg(*[F.struct(F.min(f), F.max(f)).alias(f) for f in features]).first()

    def binned(f):
        lo, hi = ends[f]  # two numbers per feature reach the driver
        if lo is None or lo == hi:
            return F.lit(0).cast("long")
        place = F.floor((F.col(f) - lo) / float(hi - lo) * bins)
        return F.least(place, F.lit(bins - 1).cast("long"))

    wide = df.select(F.col(label).alias("label"), *features)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("bin")) for f in features])
    cells = wide.select("label", F.inline(pairs)).groupBy("feature", "bin", "label").agg(
        F.count("*").alias("n")
    )
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    by_label = cells.groupBy("feature", "label").agg(F.sum("n").alias("n_label"))
    whole = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    full = cells.join(by_bin, ["feature", "bin"]).join(by_label, ["feature", "label"]).join(whole, "feature")
    n, total = F.col("n").cast("double"), F.col("n_all")
    term = n / total * F.log(n * total / (F.col("n_bin") * F.col("n_label").cast("double")))
    return full.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on, right to about 1e-12."""
    far = n + 10
    terms = {2: -1 / 12, 4: 1 / 120, 6: -1 / 252, 8: 1 / 240}
    series = F.log(far) - 1 / (2 * far) + reduce(lambda a, b: a + b, [c / F.pow(far, F.lit(float(p))) for p, c in terms.items()])
    return series - reduce(lambda a, b: a + b, [1 / (n + i) for i in range(10)])


def _kth_neighbour(k: Column, here: Column, around: Column, value: Column) -> Column:
    """Value of the k-th nearest other row of the label: `here` of them share the value, `around` lists
    (value, rows) on either side. Null where fewer than k are known."""
    by_distance = F.array_sort(F.transform(around, lambda p: F.struct(F.abs(p["value"] - value).alias("far"), p["value"].alias("value"), p["n"].alias("n"))))
    walk = F.aggregate(
        by_distance,
        F.struct(here.alias("n"), F.when(here >= k, value).alias("found")),
        lambda acc, p: F.struct((acc["n"] + p["n"]).alias("n"), F.coalesce(acc["found"], F.when(acc["n"] + p["n"] >= k, p["value"])).alias("found")),
    )
    return walk["found"]


#: Distinct (value, label) pairs of a feature in a block.
BLOCK_VALUES = 1 << 18


def neighbour_information(df: DataFrame, features: list[str], label: str, k: int = 3, blocks: int | None = None) -> DataFrame:
    """Mutual information (nats) of each number with a class, by nearest neighbours.

    For a row, let d be the distance to its k-th nearest neighbour of the same class, m the rows of any
    class nearer than d, itself included, and c the rows of its class: the estimate is
    psi(N) + psi(k) - mean psi(c) - mean psi(m). Where d is 0, k counts the row's ties in its class and m
    its ties in all, itself left out. Rows that are alone in their class, and values that are null or not
    finite, are left out; a class of k rows or fewer takes all its others as neighbours. No noise is
    added, so the result has no chance in it.

    Equal values are counted first. The distinct values are dealt out by ranges into blocks; k values on
    either side of a block come from the blocks around it, and counts between two values from running
    totals, so no feature and no class is sorted in one task.
    """
    number = lambda f: F.col(f).cast("double")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])
    rows = df.select(F.col(label).alias("label"), F.inline(pairs)).where(F.abs("value") < float("inf"))
    cells = rows.groupBy("feature", "label", "value").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("feature", "label").agg(F.sum("n").alias("of_label")).where("of_label > 1")
    cells = stored(cells.join(F.broadcast(sizes), ["feature", "label"]), "value-counts")  # a row per feature and class
    blocks = blocks or -(-cells.count() // BLOCK_VALUES) or 1
    dealt = cells.repartitionByRange(blocks, "feature", "label", "value").withColumn("_block", F.spark_partition_id())
    cut = stored(dealt, "value-blocks")

    # the k distinct values before and after each
    group = ["feature", "label", "_block"]
    pair, inside = F.struct("value", "n"), Window.partitionBy(*group).orderBy("value")
    ranked = cut.withColumns({"_up": F.row_number().over(inside), "_down": F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value")))})
    ends = ranked.where(F.least("_up", "_down") <= k).groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(F.col("_up") <= k, pair))).alias("low"), F.sort_array(F.collect_list(F.when(F.col("_down") <= k, pair))).alias("high")
    )
    over = Window.partitionBy("feature", "label").orderBy("_block")
    beside_block = ends.select(
        *group,
        F.flatten(F.collect_list("high").over(over.rowsBetween(-k, -1))).alias("before"),
        F.flatten(F.collect_list("low").over(over.rowsBetween(1, k))).alias("after"),
    )
    near = cut.withColumns({"_left": F.collect_list(pair).over(inside.rowsBetween(-k, -1)), "_right": F.collect_list(pair).over(inside.rowsBetween(1, k))})
    near = near.join(beside_block, group)
    last, first = lambda xs: F.slice(xs, -F.least(F.size(xs), F.lit(k)), k), lambda xs: F.slice(xs, 1, k)
    left, right = F.concat("before", "_left"), F.concat("_right", "after")
    around = F.concat(F.when(F.size(left) > 0, last(left)).otherwise(left), first(right))
    want = F.least(F.lit(k), F.col("of_label") - 1)
    near = near.select("feature", "label", "value", "n", "of_label", want.alias("k"), _kth_neighbour(want, F.col("n") - 1, around, F.col("value")).alias("kth"))

    # rows of any class strictly between value - d and value + d, by running totals at both
    away = F.abs(F.col("kth") - F.col("value"))
    low = F.when(F.col("kth") < F.col("value"), F.col("kth")).otherwise(F.col("value") - away)
    high = F.when(F.col("kth") > F.col("value"), F.col("kth")).otherwise(F.col("value") + away)
    near = stored(near.withColumns({"low": low, "high": high}), "neighbours")
    # at one place: totals up to `high` are read before the rows there, those up to `low` after them
    probes = near.where("low < high").select("feature", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(2).alias("kind")), F.struct(F.col("high").alias("at"), F.lit(0).alias("kind")))).alias("p"))
    probes = probes.select("feature", "p.*").distinct().withColumn("n", F.lit(0).cast("long"))
    values = cut.groupBy("feature", F.col("value").alias("at")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    axis = values.unionByName(probes)
    dealt = axis.repartitionByRange(2 * blocks, "feature", "at", "kind").withColumn("_block", F.spark_partition_id())
    axis = running(stored(dealt, "value-axis"), ["feature"], "_block", ["at", "kind"], {"below": Measure("sum", F.col("n"))})
    read = lambda kind, at, name: axis.where(F.col("kind") == kind).select("feature", F.col("at").alias(at), F.col("below").alias(name))
    ties = values.select("feature", F.col("at").alias("value"), F.col("n").alias("ties"))
    full = near.join(read(2, "low", "upto_low"), ["feature", "low"], "left").join(read(0, "high", "below_high"), ["feature", "high"], "left").join(ties, ["feature", "value"])
    tied = F.col("low") == F.col("high")
    m = F.when(tied, F.col("ties") - 1).otherwise(F.col("below_high") - F.col("upto_low"))
    neighbours = F.when(tied, F.col("n") - 1).otherwise(F.col("k"))
    mean = lambda x: F.sum(F.col("n") * digamma(x.cast("double"))) / F.sum("n")
    score = digamma(F.sum("n").cast("double")) + mean(neighbours) - mean(F.col("of_label")) - mean(m)
    return full.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))


def best_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)
