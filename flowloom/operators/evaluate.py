"""Classification metrics from a scored table: y, pred (class indexes) and proba (an array).

Threshold-free metrics need scores in order. They are computed from distinct (class, score) counts,
cut into score blocks, so no class is sorted in one task; the result is exact, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.scan import Measure, beside, running
from flowloom.session import discard, stored


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(scored: DataFrame, classes: int) -> DataFrame:
    """Flows per (y, pred) over all classes, zero-filled, with the share of the true class."""
    grid = [(y, p) for y in range(classes) for p in range(classes)]
    every = scored.sparkSession.createDataFrame(grid, "y int, pred int")
    counts = scored.groupBy("y", "pred").agg(F.count("*").alias("n"))
    full = every.join(counts, ["y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    support = full.groupBy("y").agg(F.sum("n").alias("_support"))
    share = F.col("n") / F.greatest("_support", F.lit(1))
    return full.join(support, "y").select("y", "pred", "n", share.alias("share"))


def per_class(confused: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from confusion counts."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("class_id"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )
    sums = confused.select(F.inline(sides)).groupBy("class_id").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "class_id",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted).alias("f1"),
        "support",
    )


def overall(confused: DataFrame, benign: int = 0) -> DataFrame:
    """Accuracy, macro averages over classes present in the truth, weighted F1, and the SOC rates."""
    f1 = per_class(confused)
    present = F.col("support") > 0
    averages = f1.agg(
        *[F.avg(F.when(present, F.col(c))).alias(f"macro_{c}") for c in ["precision", "recall", "f1"]],
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    n, attack, flagged = F.col("n"), F.col("y") != benign, F.col("pred") != benign
    part = lambda rule: F.sum(F.when(rule, n).otherwise(0))
    rates = confused.agg(
        ratio(part(F.col("y") == F.col("pred")), F.sum("n")).alias("accuracy"),
        ratio(part(attack & flagged), part(attack)).alias("attack_detection_rate"),
        ratio(part(~attack & flagged), part(~attack)).alias("false_positive_rate"),
    )
    return beside(rates, averages)


def score_counts(scored: DataFrame) -> DataFrame:
    """Per class and distinct score: flows of the class and of the other classes."""
    long = scored.select("y", F.posexplode("proba").alias("class_id", "score"))
    return long.groupBy("class_id", "score").agg(
        F.count_if(F.col("y") == F.col("class_id")).alias("pos"),
        F.count_if(F.col("y") != F.col("class_id")).alias("neg"),
    )


#: Distinct scores in a block of the ranking.
BLOCK_SCORES = 1 << 18


def ranked_scores(counts: DataFrame, blocks: int | None = None) -> DataFrame:
    """Adds, per row, positives and negatives with a lower score, and the class totals.

    Scores are dealt out by ranges of (class, score) into as many blocks as their number asks for, so a
    class spans the blocks its own scores need. The counts are written with their block, which no rerun
    can change then, and read by the three steps that follow. Totals are a row per class.
    """
    counts = stored(counts, "score-counts")
    blocks = blocks or -(-counts.count() // BLOCK_SCORES) or 1
    dealt = counts.repartitionByRange(blocks, "class_id", "score").withColumn("_block", F.spark_partition_id())
    cut = stored(dealt, "score-blocks")
    placed = running(
        cut,
        ["class_id"],
        "_block",
        ["score"],
        {
            "pos_below": Measure("sum", F.col("pos"), inclusive=False),
            "neg_below": Measure("sum", F.col("neg"), inclusive=False),
        },
    )
    totals = cut.groupBy("class_id").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    discard(counts)
    return placed.drop("_block").join(F.broadcast(totals), "class_id")


def ranking_metrics(scored: DataFrame, blocks: int | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) per class.

    AUC is null for a class that is absent or the only one, average precision for an absent one, so
    a plain avg over the classes gives the macro values.
    """
    r = ranked_scores(score_counts(scored), blocks)
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    wins = F.sum(pos * (F.col("neg_below") + neg / 2))
    step = F.sum(pos * tp / (tp + fp))
    sums = r.groupBy("class_id", "P", "N").agg(wins.alias("_wins"), step.alias("_step"))
    return sums.select(
        "class_id",
        F.try_divide("_wins", F.col("P").cast("double") * F.col("N")).alias("roc_auc"),
        F.try_divide("_step", F.col("P").cast("double")).alias("average_precision"),
    )


def roc_points(scored: DataFrame, class_id: int, blocks: int | None = None) -> DataFrame:
    """True and false positive rate at each distinct score of one class taken as threshold."""
    one = score_counts(scored).filter(F.col("class_id") == class_id)
    r = ranked_scores(one, blocks)
    return r.select(
        F.col("score").alias("threshold"),
        ratio(F.col("P") - F.col("pos_below"), F.col("P")).alias("tpr"),
        ratio(F.col("N") - F.col("neg_below"), F.col("N")).alias("fpr"),
    )


def as_binary(scored: DataFrame, benign: int = 0) -> DataFrame:
    """Attack (1) against benign (0); the attack score is what the benign class leaves."""
    rest = 1 - F.element_at("proba", benign + 1)
    return scored.select(
        (F.col("y") != benign).cast("int").alias("y"),
        (F.col("pred") != benign).cast("int").alias("pred"),
        F.array(1 - rest, rest).alias("proba"),
    )


def binary_report(binary: DataFrame, blocks: int | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and false positive rate of class 1."""
    confused = confusion(binary, 2)
    attack = per_class(confused).filter("class_id = 1").select("precision", "recall", "f1")
    rates = overall(confused).select("accuracy", "false_positive_rate")
    auc = ranking_metrics(binary, blocks).filter("class_id = 1").select(F.col("roc_auc").alias("auc"))
    return beside(rates, attack, auc)


def fold_scores(scored: DataFrame, classes: int) -> DataFrame:
    """Macro F1 over the classes present in each fold. Input has a `fold` column."""
    counts = scored.groupBy("fold", "y", "pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("c"), hit.alias("tp"), F.col("n").alias("t"), zero.alias("p")),
        F.struct(F.col("pred").alias("c"), zero.alias("tp"), zero.alias("t"), F.col("n").alias("p")),
    )
    sums = counts.select("fold", F.inline(sides)).groupBy("fold", "c").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")
    )
    f1 = ratio(2 * F.col("tp"), F.col("t") + F.col("p"))
    return sums.filter("t > 0").groupBy("fold").agg(F.avg(f1).alias("macro_f1"))


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"))
