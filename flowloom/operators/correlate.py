"""Detections to alerts.

Detections correlate by (label, dst_ip) in arrival order. While nothing is closed, the newest alert
of a key has the largest last-seen time, so a detection opens a new alert exactly when its time is
later than the running maximum of the key plus the window. The alert id is the event id of the
detection that opened it: unique, ordered, and known without a global counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.alerts import (
    advice,
    description,
    raises_alert,
    severity,
    severity_name,
    severity_rank,
)
from flowloom.operators.scan import BLOCK_BITS, Opener, id_block, running_sessions
from flowloom.registry import MIN_RISK, SEVERITIES, WINDOW_MINUTES
from flowloom.sources.settings import in_force

KEY = ["label", "dst_ip"]


def micros(column):
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column)


def sessions(
    df: DataFrame,
    keys: list[str],
    gap_seconds: float | Column,
    order: list[str],
    ts: str = "ts",
    levels: int = 1,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Adds `opener`, the order columns (and time) of the row that opened the row's session.

    `order` starts with an integer arrival number and must be unique in full. `block_bits` says how far
    apart the numbers of 2**20 rows lie at most: 20 where numbers are dense. The gap may differ from row
    to row.
    """
    rows = df.withColumn("_block", id_block(F.col(order[0]), block_bits))
    if isinstance(gap_seconds, Column):
        gap = (gap_seconds.cast("double") * 1_000_000).cast("long")
    else:
        gap = int(gap_seconds * 1_000_000)
    opener = Opener(gap, F.struct(*order, F.col(ts).alias("opened_at")))
    found = running_sessions(rows, keys, "_block", order, micros(ts), {"opener": opener}, levels=levels)
    return found.select(*df.columns, "opener")


def assign_alerts(
    detections: DataFrame,
    window_minutes: int = WINDOW_MINUTES,
    min_risk: int = MIN_RISK,
    order: list[str] = ["event_id"],
    levels: int = 1,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """The detections that raise alerts, each with its `alert_id`."""
    raised = detections.filter(raises_alert(F.col("label"), F.col("risk_score"), min_risk))
    found = sessions(raised, KEY, window_minutes * 60, order, levels=levels, block_bits=block_bits)
    return found.withColumn("alert_id", F.col(f"opener.{order[-1]}")).drop("opener")


def assign_under_settings(
    detections: DataFrame, versions: DataFrame, order: list[str] = ["event_id"], levels: int = 1, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """A replay: like `assign_alerts`, with the threshold and window in force when each detection came.

    `versions` are stored settings (`sources.settings`); before the first one the defaults hold. Adds
    `settings_version` (0 for the defaults) and `alert_id`.
    """
    held = in_force(detections, versions)
    raised = held.filter(raises_alert(F.col("label"), F.col("risk_score"), F.col("_config.min_risk")))
    found = sessions(raised, KEY, F.col("_config.window_minutes") * 60, order, levels=levels, block_bits=block_bits)
    return found.withColumn("alert_id", F.col(f"opener.{order[-1]}")).drop("opener", "_config")


def rollup(assigned: DataFrame, order: list[str] = ["event_id"], carried: list[str] | None = None) -> DataFrame:
    """One row per alert.

    Counters are sums and extremes. Source, model version and whatever else is in `carried` come
    from the riskiest detection, the earliest on ties; port and protocol from the first one. The
    `first_in_band` columns hold (order, risk) of the first detection of each severity band.
    """
    carried = carried or ["src_ip", "model_version"]
    arrival = F.struct(*order)
    descending = F.struct(F.col("risk_score"), *[(-F.col(c)).alias(c) for c in order])
    rank = severity_rank(F.col("risk_score"))
    bands = [
        F.min(F.when(rank == i, F.struct(*order, "risk_score"))).alias(f"first_{name.lower()}")
        for i, name in enumerate(SEVERITIES)
    ]
    grouped = assigned.groupBy("alert_id", *KEY).agg(
        F.count("*").alias("detection_count"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_seen_at"),
        F.max("packets_per_sec").alias("peak_packets_per_sec"),
        F.max("bytes_per_sec").alias("peak_bytes_per_sec"),
        F.max("confidence").alias("confidence"),
        F.max("risk_score").alias("risk_score"),
        F.max_by(F.struct(*carried), descending).alias("_top"),
        F.min_by(F.struct("dst_port", "protocol"), arrival).alias("_first"),
        *bands,
    )
    band = severity(F.col("risk_score"))
    top = {c: F.col(f"_top.{c}") for c in carried}
    return grouped.select(
        "alert_id",
        F.col("label").alias("attack_type"),
        top["src_ip"].alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("_first.dst_port").alias("destination_port"),
        F.col("_first.protocol").alias("protocol"),
        "first_seen_at",
        "last_seen_at",
        "detection_count",
        "peak_packets_per_sec",
        "peak_bytes_per_sec",
        "confidence",
        "risk_score",
        band.alias("severity"),
        description(F.col("label"), F.col("confidence"), F.col("dst_ip"), F.col("_first.dst_port")).alias(
            "description"
        ),
        advice(F.col("label"), band, top["src_ip"], F.col("dst_ip")).alias("recommended_action"),
        *[c.alias(name) for name, c in top.items() if name != "src_ip"],
        *[f"first_{name.lower()}" for name in SEVERITIES],
    )


def escalations(alerts: DataFrame, order: list[str] = ["event_id"]) -> DataFrame:
    """Detections that lifted an alert into a higher band.

    Such a detection is the first of its band and comes before every first detection of a higher
    one; the band before is the highest that started earlier. Four structs per alert decide it, so
    no window over the detections is needed.
    """
    firsts = [F.col(f"first_{name.lower()}") for name in SEVERITIES]
    candidates = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                firsts[i].alias("at"),
                F.least(firsts[i], *firsts[i + 1 :], *([firsts[i]] if i == 3 else [])).alias("reached"),
                F.greatest(
                    F.lit(-1), *[F.when(firsts[j] < firsts[i], F.lit(j)) for j in range(i)], F.lit(-1)
                ).alias("before"),
            )
            for i in range(len(SEVERITIES))
        ]
    )
    steps = alerts.select("alert_id", F.explode(candidates).alias("s"))
    real = (F.col("s.at") == F.col("s.reached")) & (F.col("s.before") >= 0)
    return steps.filter(real).select(
        "alert_id",
        F.col(f"s.at.{order[-1]}").alias("event_id"),
        severity_name(F.col("s.before")).alias("before_severity"),
        severity_name(F.col("s.rank")).alias("after_severity"),
        F.col("s.at.risk_score").alias("risk_score"),
    )


def links(assigned: DataFrame) -> DataFrame:
    return assigned.select("alert_id", "event_id")


def change_feed(assigned: DataFrame) -> DataFrame:
    """One message per absorbed detection: the opening one is new, the others are updates."""
    kind = F.when(F.col("event_id") == F.col("alert_id"), "alert.new").otherwise("alert.updated")
    return assigned.select("event_id", "alert_id", kind.alias("type"), "label", "dst_ip", "risk_score")


def system_audit(alerts: DataFrame, lifted: DataFrame) -> DataFrame:
    """Audit rows written while correlating: one per alert opened, one per escalation."""
    order = F.col("alert_id")
    band = lambda s, r: F.to_json(F.struct(s.alias("severity"), r.alias("risk_score")))
    firsts = [F.col(f"first_{name.lower()}") for name in SEVERITIES]
    opened = F.least(*firsts).getField("risk_score")
    created = alerts.select(
        F.lit("system").alias("actor"),
        F.lit("alert.created").alias("action"),
        F.lit("alert").alias("entity_type"),
        order.cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("before"),
        band(severity(opened), opened).alias("after"),
    )
    raised = lifted.select(
        F.lit("system").alias("actor"),
        F.lit("alert.escalated").alias("action"),
        F.lit("alert").alias("entity_type"),
        order.cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("before_severity").alias("severity"))).alias("before"),
        band(F.col("after_severity"), F.col("risk_score")).alias("after"),
    )
    return created.unionByName(raised)
