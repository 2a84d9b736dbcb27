"""Flow features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.registry import CLASSES, FEATURE_NAMES, LABELS, MEASURED, RARE_LABELS


def lookup(column: Column, table: dict) -> Column:
    """Value of a small literal table, null where the key is absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*pairs), column)


def finite(column: str) -> str:
    """NaN, infinities and null become 0: only a number below infinity passes the comparison."""
    return f"CASE WHEN abs({column}) < double('infinity') THEN {column} ELSE 0D END"


def per_second(total: str, duration: str) -> str:
    """total / duration, 0 unless duration is a positive number (NaN sorts above infinity)."""
    return f"CASE WHEN {duration} > 0 AND {duration} <= double('infinity') THEN ({total}) / {duration} ELSE 0D END"


def _features(df: DataFrame, keep: list[Column], numbers: list[str]) -> DataFrame:
    """Rates from totals and duration, then every feature made finite, in registry order."""
    rates = {
        "flow_bytes_per_s": per_second("fwd_bytes + bwd_bytes", "flow_duration_s"),
        "flow_packets_per_s": per_second("fwd_packets + bwd_packets", "flow_duration_s"),
    }
    measured = df.select(*keep, *[F.expr(n) for n in numbers])
    kept = measured.columns[: len(keep)]
    rated = measured.select("*", *[F.expr(f"{text} AS {name}") for name, text in rates.items()])
    return rated.select(*kept, *[F.expr(f"{finite(n)} AS {n}") for n in FEATURE_NAMES])


def from_source_columns(df: DataFrame, keep: list[Column]) -> DataFrame:
    """Features of flow CSV rows beside the `keep` columns: unreadable text ends as 0."""
    scaled = {f.name: "" if f.scale == 1.0 else f" * {f.scale!r}D" for f in MEASURED}
    numbers = [f"try_cast(`{f.source}` AS double){scaled[f.name]} AS {f.name}" for f in MEASURED]
    return _features(df, keep, numbers)


def from_records(df: DataFrame, keep: list[Column]) -> DataFrame:
    """Features of live records named like the features; rates are recomputed, extras ignored."""
    missing = [f.name for f in MEASURED if f.name not in df.columns]
    if missing:
        raise ValueError(f"flow records lack features: {missing}")
    return _features(df, keep, [f"try_cast({f.name} AS double) AS {f.name}" for f in MEASURED])


def signed_log(column: Column) -> Column:
    return F.signum(column) * F.log1p(F.abs(column))


def label_text(column: Column) -> Column:
    """Lower case, each run of other characters one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def is_rare(text: Column) -> Column:
    return text.isin(*RARE_LABELS)


def label_class(text: Column) -> Column:
    """Class of a normalised label; a label outside the table fails the job."""
    known = lookup(text, LABELS)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unmapped label: "), text)))


def class_index(label: Column, classes=CLASSES) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), label).cast("int") - 1
