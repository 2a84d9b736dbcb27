"""Queries over classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.operators import evaluate

CLASSES = 7  # two more than the scored table holds, so absent classes are covered

GRID = """grid as (select cast(y.i as integer) as y, cast(p.i as integer) as pred from range(7) y(i), range(7) p(i)
), cells as (
  select g.y, g.pred, count(s.event_id) as n from grid g left join scored s on s.y = g.y and s.pred = g.pred group by 1, 2
), metric as (
  select c.i as class_id, tp, support, predicted, coalesce(tp / nullif(predicted, 0)::double, 0) as precision,
    coalesce(tp / nullif(support, 0)::double, 0) as recall,
    coalesce(2 * tp / nullif(support + predicted, 0)::double, 0) as f1
  from (select cast(i as integer) as i, (select sum(n) from cells where y = i and pred = i) as tp,
      (select sum(n) from cells where y = i) as support, (select sum(n) from cells where pred = i) as predicted
    from range(7) r(i)) c
)"""

METRICS = ["precision", "recall", "f1"]


def confused(spark, d):
    return evaluate.confusion(fx.scored(spark, d), CLASSES)


@register(
    q.query(
        [q.SCORED, GRID],
        "select y, pred, n, round(n / greatest(sum(n) over (partition by y), 1)::double, 6) as share from cells",
    )
)
def confusion_matrix(spark, d):
    return confused(spark, d).withColumn("share", F.round("share", 6))


@register(
    q.query(
        [q.SCORED, GRID],
        f"""select class_id, cast(support as bigint) as support, {", ".join(f"round({m}, 6) as {m}" for m in METRICS)}
from metric""",
    )
)
def per_class_metrics(spark, d):
    return evaluate.per_class(confused(spark, d)).select(
        "class_id", "support", *[F.round(m, 6).alias(m) for m in METRICS]
    )


@register(
    q.query(
        [q.SCORED, GRID],
        f"""select {", ".join(f"(select round(avg({m}), 6) from metric where support > 0) as macro_{m}" for m in METRICS)},
  (select round(sum(f1 * support) / sum(support), 6) from metric) as weighted_f1,
  round(avg(case when y = pred then 1.0::double else 0 end), 6) as accuracy,
  round(sum(case when y <> 0 and pred <> 0 then 1 else 0 end) / greatest(sum(case when y <> 0 then 1 else 0 end), 1)::double, 6)
    as attack_detection_rate,
  round(sum(case when y = 0 and pred <> 0 then 1 else 0 end) / greatest(sum(case when y = 0 then 1 else 0 end), 1)::double, 6)
    as false_positive_rate
from scored""",
    )
)
def overall_metrics(spark, d):
    found = evaluate.overall(confused(spark, d))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


LONG = f"""long as (
  {" union all ".join(f"select event_id, {c} as class_id, y, p{c} as score from scored" for c in range(5))}
), counts as (
  select class_id, score, count(case when y = class_id then 1 end) as pos, count(case when y <> class_id then 1 end) as neg
  from long group by 1, 2
), ranked as (
  select *, coalesce(sum(pos) over b, 0) as pos_below, coalesce(sum(neg) over b, 0) as neg_below,
    sum(pos) over (partition by class_id) as p_all, sum(neg) over (partition by class_id) as n_all
  from counts window b as (partition by class_id order by score rows between unbounded preceding and 1 preceding)
)"""


@register(
    q.query(
        [q.SCORED, LONG],
        """select class_id, round(sum(pos * (neg_below + neg / 2.0::double)) / (p_all::double * n_all), 6) as roc_auc,
  round(sum(pos * (p_all - pos_below)::double / (p_all - pos_below + n_all - neg_below)) / p_all, 6) as average_precision
from ranked group by class_id, p_all, n_all""",
    )
)
def ranking_metrics(spark, d):
    found = evaluate.ranking_metrics(fx.scored(spark, d))
    return found.select("class_id", F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


@register(
    q.query(
        [q.SCORED, LONG],
        """select round(avg(roc_auc), 6) as roc_auc_macro, round(avg(average_precision), 6) as pr_auc_macro from (
  select class_id, sum(pos * (neg_below + neg / 2.0::double)) / (p_all::double * n_all) as roc_auc,
    sum(pos * (p_all - pos_below)::double / (p_all - pos_below + n_all - neg_below)) / p_all as average_precision
  from ranked group by class_id, p_all, n_all)""",
    )
)
def macro_ranking_metrics(spark, d):
    return evaluate.ranking_metrics(fx.scored(spark, d)).agg(
        F.round(F.avg("roc_auc"), 6).alias("roc_auc_macro"),
        F.round(F.avg("average_precision"), 6).alias("pr_auc_macro"),
    )


@register(
    q.query(
        [q.SCORED, LONG],
        """select round(score, 9) as threshold, round((p_all - pos_below)::double / p_all, 6) as tpr,
  round((n_all - neg_below)::double / n_all, 6) as fpr from ranked where class_id = 4""",
    )
)
def roc_points(spark, d):
    return evaluate.roc_points(fx.scored(spark, d), 4).select(
        F.round("threshold", 9).alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")
    )


@register(
    q.query(
        [
            q.SCORED,
            """two as (select case when y <> 0 then 1 else 0 end as y, case when pred <> 0 then 1 else 0 end as pred, 1 - p0 as score
  from scored
), counts as (
  select score, count(case when y = 1 then 1 end) as pos, count(case when y = 0 then 1 end) as neg from two group by 1
), ranked as (
  select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from counts
), f as (
  select sum(y * pred) as tp, sum(y) as p, sum(pred) as flagged, count(*) as n, sum(case when y = pred then 1 else 0 end) as ok
  from two
)""",
        ],
        """select round(ok / n::double, 6) as accuracy, round(tp / flagged::double, 6) as precision, round(tp / p::double, 6) as recall,
  round(2 * tp / (p + flagged)::double, 6) as f1, round((flagged - tp) / (n - p)::double, 6) as false_positive_rate,
  (select round(sum(pos * (below + neg / 2.0::double)) / (sum(pos)::double * sum(neg)), 6) from ranked) as auc
from f""",
    )
)
def binary_report(spark, d):
    found = evaluate.binary_report(evaluate.as_binary(fx.scored(spark, d)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@register(
    q.query(
        [
            q.SCORED,
            """sides as (
  select event_id % 5 as fold, y as c, case when y = pred then 1 else 0 end as tp, 1 as t, 0 as p from scored
  union all select event_id % 5, pred, 0, 0, 1 from scored
), f as (
  select fold, c, 2 * sum(tp) / (sum(t) + sum(p))::double as f1 from sides group by 1, 2 having sum(t) > 0
), folds as (select fold, avg(f1) as macro_f1 from f group by 1)""",
        ],
        "select round(avg(macro_f1), 6) as mean, round(stddev_pop(macro_f1), 6) as std from folds",
    )
)
def fold_summary(spark, d):
    scores = evaluate.fold_scores(fx.scored(spark, d).withColumn("fold", F.col("event_id") % 5), 5)
    found = evaluate.fold_summary(scores)
    return found.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
