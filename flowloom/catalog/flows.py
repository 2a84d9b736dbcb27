"""Queries over flow features, cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.functions.flows import class_index, from_source_columns, label_text, signed_log
from flowloom.operators import clean as cleaning
from flowloom.operators import split as splitting
from flowloom.plans import training
from flowloom.registry import CLASSES, FEATURE_NAMES
from flowloom.session import cut_lineage


def cleaned(spark, d):
    return cleaning.clean(fx.raw_flows(spark, d))


def divided(spark, d):
    """The split reads the cleaned flows three times (block totals, positions, group sizes), so they
    are written once instead of being deduplicated three times."""
    return splitting.temporal_split(cut_lineage(cleaned(spark, d)))


ROUNDED = ", ".join(f"round({n}, 6) as {n}" for n in FEATURE_NAMES)


def rounded(names=FEATURE_NAMES):
    return [F.round(n, 6).alias(n) for n in names]


@register(q.query([q.FLOWS], f"select capture_order, label_text, {ROUNDED} from featured"))
def flow_features(spark, d):
    text = label_text(F.col("raw_label")).alias("label_text")
    found = from_source_columns(fx.raw_flows(spark, d), [F.col("capture_order"), text])
    return found.select("capture_order", "label_text", *rounded())


@register(q.query([q.FLOWS, q.CLEANED], f"select source_file, capture_order, grp, label, {ROUNDED} from cleaned"))
def flow_clean(spark, d):
    return cleaned(spark, d).select("source_file", "capture_order", "grp", "label", *rounded())


@register(
    q.query(
        [q.FLOWS, q.CLEANED],
        f"""select (select count(*) from featured) as rows_loaded,
  (select count(*) from featured where label_text in ({q.listing(q.RARE_LABELS)})) as dropped_rare_classes,
  (select count(*) from featured where label_text not in ({q.listing(q.RARE_LABELS)}) and flow_duration_s < 0)
    as dropped_negative_duration,
  (select count(*) from valid) - (select count(*) from deduped) as dropped_exact_duplicates,
  (select count(*) from deduped) - (select count(*) from cleaned) as dropped_conflicting_labels,
  (select count(*) from cleaned) as rows_kept""",
    )
)
def cleaning_report(spark, d):
    return cleaning.cleaning_report(fx.raw_flows(spark, d))


@register(
    q.query(
        [q.FLOWS],
        f"""select distinct label_text from featured
where label_text not in ({q.listing([k for k in q.LABELS if k not in ("portscan", "ddos")])})""",
    )
)
def labels_outside_subset(spark, d):
    """The unknown-label check, run against a mapping without two labels and without the rare ones."""
    known = [t for t in q.LABELS if t not in ("portscan", "ddos")]
    return cleaning.unknown_labels(fx.raw_flows(spark, d), known, ())


@register(q.query([q.FLOWS, q.CLEANED, q.SPLIT], "select * from split"))
def temporal_split(spark, d):
    return divided(spark, d).drop(*FEATURE_NAMES)


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        "select label, is_train, fold, count(*) as flows from split group by all",
    )
)
def fold_sizes(spark, d):
    return divided(spark, d).groupBy("label", "is_train", "fold").agg(F.count("*").alias("flows"))


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        """select label, count(*) as flows, count(case when is_train then 1 end) as train,
  count(case when not is_train then 1 end) as test from split group by 1""",
    )
)
def class_counts(spark, d):
    return training.class_counts(divided(spark, d))


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        """select capture_order, label from split where is_train
qualify row_number() over (partition by label order by md5(cast(capture_order as varchar) || '|42'), capture_order) <= 150""",
    )
)
def cap_per_class(spark, d):
    train = divided(spark, d).filter("is_train")
    return splitting.cap_per_class(train, 150, "capture_order", 42).select("capture_order", "label")


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        """select capture_order, label from split where not is_train
qualify row_number() over (partition by label order by md5(cast(capture_order as varchar) || '|7'), capture_order) <= 28""",
    )
)
def stratified_sample(spark, d):
    test = divided(spark, d).filter("not is_train")
    return splitting.stratified_sample(test, 200, len(CLASSES), "capture_order", 7).select("capture_order", "label")


@register(
    q.query(
        [q.FLOWS, q.CLEANED],
        "select capture_order, label from cleaned qualify row_number() over (partition by label order by capture_order) <= 3",
    )
)
def first_per_class(spark, d):
    return splitting.first_per_class(cleaned(spark, d), 3, "capture_order").select("capture_order", "label")


LOGGED = ", ".join(f"round(sign({n}) * ln(1 + abs({n})), 6) as {n}" for n in FEATURE_NAMES)


@register(
    q.query(
        [q.FLOWS, q.CLEANED],
        f"""select capture_order, cast(case label {" ".join(f"when '{c}' then {i}" for i, c in enumerate(CLASSES))} end as integer)
  as class_id, {LOGGED} from cleaned""",
    )
)
def model_input(spark, d):
    return cleaned(spark, d).select(
        "capture_order",
        class_index(F.col("label")).alias("class_id"),
        *[F.round(signed_log(F.col(n)), 6).alias(n) for n in FEATURE_NAMES],
    )


@register(
    q.query(
        [q.FLOWS, q.CLEANED],
        " union all ".join(
            f"select '{n}' as feature, round(avg({n}), 6) as mean, round(stddev_pop({n}), 6) as std from cleaned"
            for n in FEATURE_NAMES
        ),
    )
)
def scaler_statistics(spark, d):
    return training.column_statistics(cleaned(spark, d), FEATURE_NAMES).select(
        "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


@register(
    q.query(
        [q.FLOWS, q.CLEANED, q.SPLIT],
        """, counts as (select label, count(*) as n from split where is_train group by 1)
select label, n, round((select sum(n) from counts)::double / ((select count(*) from counts) * n), 6) as weight from counts""".replace(
            ", counts", "select * from (with counts", 1
        ).replace(") * n), 6) as weight from counts", ") * n), 6) as weight from counts)"),
    )
)
def class_weights(spark, d):
    weights = training.class_weights(divided(spark, d).filter("is_train"))
    return weights.select("label", "n", F.round("weight", 6).alias("weight"))
