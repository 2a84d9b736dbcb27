"""Risk signals and score, cross-flow features, notifications.

These are described in the design of what this library covers, without numbers beyond the weights
and three class values; the constants below are parameters of this implementation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.alerts import severity_rank
from flowloom.functions.flows import lookup
from flowloom.functions.net import subnet24
from flowloom.operators.correlate import micros
from flowloom.operators.scan import Measure, id_block, running
from flowloom.operators.spacing import greedy_windows
from flowloom.registry import BENIGN, SEVERITIES, WEIGHTS

# Fixed values for ddos, botnet and portscan; the others are chosen between them.
CLASS_SEVERITY = {
    "ddos": 90.0,
    "dos": 85.0,
    "botnet": 80.0,
    "webattack": 70.0,
    "bruteforce": 65.0,
    "portscan": 50.0,
}


def attack_severity(label: Column, packet_count: Column) -> Column:
    """Class value, between half of it for a single packet and all of it from 100,000 packets on."""
    volume = F.least(F.log10(packet_count + 1) / 5, F.lit(1.0))
    return F.coalesce(lookup(label, CLASS_SEVERITY), F.lit(0.0)) * (0.5 + 0.5 * volume)


def _median(values: Column, zeros: Column) -> Column:
    """Median of non-negative `values` and so many zeros; null if there is neither."""
    ordered, n = F.array_sort(values), F.size(values) + zeros
    at = lambda i: F.when(i < zeros, F.lit(0.0)).otherwise(F.get(ordered, (i - zeros).cast("int")))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def _anomaly(name: str, decay: float) -> Column:
    """Squashed distance of a value above the decayed mean of its history, in robust deviations.

    `past` lists (age in buckets from 0, value) of the buckets with traffic among the last `n`.
    """
    n, silent, add = F.col("n"), F.col("n") - F.size("past"), lambda a, x: a + x
    weighted = F.transform("past", lambda p: p[name] * F.pow(F.lit(decay), p["age"].cast("double")))
    total = (1 - F.pow(F.lit(decay), n.cast("double"))) / (1 - decay) if decay != 1 else n
    mean = F.aggregate(weighted, F.lit(0.0), add) / total
    middle = F.col(f"mid_{name}")
    # a silent bucket lies as far from the median as the median is high
    away = F.concat(F.transform("past", lambda p: F.abs(p[name] - middle)), F.array_repeat(middle, silent.cast("int")))
    spread = 1.4826 * _median(away, F.lit(0))
    z = F.greatest((F.col(name) - mean) / F.greatest(spread, 0.05 * mean, F.lit(1.0)), F.lit(0.0))
    return F.when(n > 0, 100 * z / (z + 3)).otherwise(0.0)


SECOND = 1_000_000
RATES = ["flows", "packets", "bytes"]
#: Buckets of a destination that one task holds, beside the history before them.
SPAN = 4096


def traffic_anomaly(events: DataFrame, bucket_seconds: int = 3600, history: int = 24, decay: float = 0.7, span: int = SPAN) -> DataFrame:
    """Signal 0 to 100 per destination and bucket, against that destination's `history` buckets before.

    The history goes by time: buckets without traffic since the destination was first seen are zeros,
    in the decayed mean as in the median and the deviation from it. Traffic is summed per (destination,
    bucket) first. The buckets of one destination are cut into spans; each span gets a copy of the
    history that its first buckets look back on, so a destination of any age and any bucket width splits.
    """
    if span < history:
        raise ValueError("a span must hold the history")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_seconds).alias("slot")
    sums = events.groupBy("dst_ip", slot).agg(
        F.count("*").cast("double").alias("flows"),
        F.sum("packet_count").cast("double").alias("packets"),
        F.sum("byte_count").cast("double").alias("bytes"),
    )
    first = sums.groupBy("dst_ip").agg(F.min("slot").alias("first_slot"))
    at = F.floor(F.col("slot") / span)
    reaches = F.pmod("slot", F.lit(span)) >= span - history
    copies = F.array(F.struct(at.alias("_span"), F.lit(True).alias("_own")), F.struct(F.when(reaches, at + 1).alias("_span"), F.lit(False).alias("_own")))
    spread = sums.select("*", F.inline(copies)).where("_span is not null")
    before = Window.partitionBy("dst_ip", "_span").orderBy("slot").rangeBetween(-history, -1)
    past = spread.withColumn("past", F.collect_list(F.struct("slot", *RATES)).over(before)).where("_own").join(first, "dst_ip")
    aged = F.transform("past", lambda p: F.struct((F.col("slot") - 1 - p["slot"]).alias("age"), *[p[c].alias(c) for c in RATES]))
    past = past.withColumns({"past": aged, "n": F.least(F.col("slot") - F.col("first_slot"), F.lit(history))})
    values = lambda name: F.transform("past", lambda p: p[name])
    past = past.withColumns({f"mid_{c}": _median(values(c), F.col("n") - F.size("past")) for c in RATES})
    signals = [_anomaly(c, decay) for c in RATES]
    start = F.timestamp_seconds(F.col("slot") * bucket_seconds).alias("bucket")
    return past.select("dst_ip", start, *RATES, F.greatest(*signals).alias("traffic_anomaly"))


def source_reputation(detections: DataFrame, alerts: DataFrame, order: str = "event_id") -> DataFrame:
    """Detections with the number of earlier alerts from the same source and the same subnet.

    Alerts and detections are laid on one axis by arrival number and a running total is read at the
    detections, in blocks, so one source or subnet may own most rows.
    """
    zero, one = F.lit(0), F.lit(1)
    marks = alerts.select(F.col("source_ip").alias("src_ip"), F.col("alert_id").alias(order), one.alias("_is"))
    rows = detections.select("src_ip", order, zero.alias("_is"))
    axis = rows.unionByName(marks).withColumns(
        {"_net": subnet24(F.col("src_ip")), "_block": id_block(F.col(order))}
    )
    arrival = [order, "_is"]  # an alert opened by this very detection is not an earlier one
    total = Measure("sum", F.col("_is"), inclusive=False)
    axis = running(axis, ["src_ip"], "_block", arrival, {"prior_source": total})
    axis = running(axis, ["_net"], "_block", arrival, {"prior_subnet": total})
    found = axis.filter(F.col("_is") == 0).select(
        "src_ip", order, F.col("prior_source").cast("long"), F.col("prior_subnet").cast("long")
    )
    signal = F.least(F.lit(100.0), 20.0 * F.col("prior_source") + 0.1 * F.col("prior_subnet"))
    return found.withColumn("source_reputation", signal)


def risk_score(label: Column, signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the four signals, halves to the even number; benign flows have none."""
    total = sum((signals[name] * weight for name, weight in weights.items()), F.lit(0.0))
    return F.when(label == BENIGN, 0).otherwise(F.rint(total).cast("int"))


def score_detections(
    detections: DataFrame, alerts: DataFrame, weights: dict[str, float] = WEIGHTS
) -> DataFrame:
    """The four signals of every detection and its risk.

    A detection is judged by what is known when it comes: the anomaly is that of the last full hour,
    and none if the destination had no traffic then.
    """
    full = traffic_anomaly(detections).select("dst_ip", (F.col("bucket") + F.expr("interval 1 hour")).alias("_hour"), "traffic_anomaly")
    known = source_reputation(detections, alerts).drop("src_ip")
    rows = detections.withColumn("_hour", F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600))
    rows = rows.join(full, ["dst_ip", "_hour"], "left").drop("_hour").join(known, "event_id")
    rows = rows.withColumns(
        {
            "traffic_anomaly": F.coalesce("traffic_anomaly", F.lit(0.0)),
            "ml_confidence": F.col("confidence") * 100,
            "attack_severity": attack_severity(F.col("label"), F.col("packet_count")),
        }
    )
    signals = {name: F.col(name) for name in WEIGHTS}
    return rows.withColumn("risk", risk_score(F.col("label"), signals, weights))


def destination_features(events: DataFrame, window: str = "1 hour", seconds: int = 3600) -> DataFrame:
    """Flows, flow rate and distinct sources per destination and window."""
    return events.groupBy(F.window("ts", window).start.alias("window_start"), "dst_ip").agg(
        F.count("*").alias("flows"),
        (F.count("*") / seconds).alias("flows_per_s"),
        F.count_distinct("src_ip").alias("unique_sources"),
    )


def source_features(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Distinct destination hosts and ports per source and window."""
    return events.groupBy(F.window("ts", window).start.alias("window_start"), "src_ip").agg(
        F.count("*").alias("flows"),
        F.count_distinct("dst_ip").alias("unique_hosts"),
        F.count_distinct("dst_port").alias("unique_ports"),
    )


def fitting_messages(messages: DataFrame, rules: dict[str, tuple[str, int]]) -> DataFrame:
    """Each message once per channel whose least severity it reaches, with the channel's period in microseconds."""
    channel = F.array(
        *[
            F.struct(F.lit(name).alias("channel"), F.lit(SEVERITIES.index(least)).alias("least"), F.lit(seconds * SECOND).cast("long").alias("period"))
            for name, (least, seconds) in rules.items()
        ]
    )
    each = messages.select("alert_id", "event_id", "ts", "risk_score", F.inline(channel))
    return each.where(severity_rank(F.col("risk_score")) >= F.col("least")).drop("least")


def notifications(messages: DataFrame, rules: dict[str, tuple[str, int]]) -> DataFrame:
    """What to send: per channel (least severity, seconds), the first message of an alert, then the first
    at least that many seconds after the last one sent.

    `messages` has alert_id, event_id, ts, risk_score. Of messages at the same instant the one with the
    smallest event_id is sent. held_back counts what a message sent stands for beside itself.
    """
    each = fitting_messages(messages, rules)
    placed = greedy_windows(each, ["channel", "alert_id"], micros("ts"), F.col("period"))
    first = F.min(F.when(micros("ts") == F.col("window_us"), F.struct("event_id", "risk_score")))
    sent = placed.groupBy("channel", "alert_id", "window_us").agg(first.alias("m"), (F.count("*") - 1).alias("held_back"))
    return sent.select("channel", "alert_id", F.timestamp_micros("window_us").alias("sent_at"), "m.event_id", "m.risk_score", "held_back")
