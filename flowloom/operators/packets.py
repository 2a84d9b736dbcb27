"""Packet headers: trailing counts per source, encoded features, and flows built from packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.flows import lookup
from flowloom.operators.correlate import micros
from flowloom.operators.scan import BLOCK_BITS, Measure, Opener, id_block, running, running_sessions
from flowloom.registry import FLAG_CODES, IP_PROTOCOLS, PORT_SERVICES, PROTOCOL_CODES, SERVICE_CODES

SECOND = 1_000_000


def trailing_count(
    packets: DataFrame, seconds: int = 2, source: str = "src", seq: str = "event_id", ts: str = "ts"
) -> DataFrame:
    """Adds `count`: packets of the source in [ts - seconds, ts] that arrived up to this one.

    Packets arrive in time order. The count is (packets before ts) - (packets before ts - seconds)
    plus the place among packets of the same instant: two reads of one running total instead of a
    sliding frame, whose cost grows with the packets inside it. The total runs over distinct
    instants in blocks of one second, at most a million rows each, however hot the source is.
    """
    rows = packets.withColumn("_us", micros(ts))
    instants = rows.groupBy(source, "_us").agg(F.count("*").alias("_n"))
    zero = F.lit(0).cast("long")
    back = F.col("_us") - seconds * SECOND
    ticks = F.array(
        F.struct(F.col("_us").alias("t"), F.col("_n").alias("n"), F.lit(True).alias("seen"), F.lit(False).alias("probe")),
        F.struct(back.alias("t"), zero.alias("n"), F.lit(False).alias("seen"), F.lit(True).alias("probe")),
    )
    axis = instants.select(source, F.inline(ticks)).groupBy(source, "t").agg(
        F.sum("n").alias("n"), F.bool_or("seen").alias("seen"), F.bool_or("probe").alias("probe")
    )
    axis = axis.withColumn("_block", F.floor(F.col("t") / SECOND))
    axis = running(axis, [source], "_block", ["t"], {"before": Measure("sum", F.col("n"), False)})
    reads = F.array(
        F.when(F.col("seen"), F.struct(F.col("t").alias("_us"), F.col("before").alias("gain"))),
        F.when(F.col("probe"), F.struct((F.col("t") + seconds * SECOND).alias("_us"), (-F.col("before")).alias("gain"))),
    )
    earlier = axis.select(source, F.explode(F.array_compact(reads)).alias("r"))
    earlier = earlier.groupBy(source, F.col("r._us").alias("_us")).agg(F.sum("r.gain").alias("_earlier"))
    placed = running(
        rows.withColumn("_block", id_block(F.col(seq))),
        [source, "_us"],
        "_block",
        [seq],
        {"_place": Measure("sum", F.lit(1), inclusive=True)},
    )
    return placed.join(earlier, [source, "_us"]).select(
        *packets.columns, (F.col("_earlier") + F.col("_place")).cast("long").alias("count")
    )


def flag_code(protocol: Column, flags: Column, icmp_type: Column) -> Column:
    """Connection flag class of one packet.

    Every TCP packet with ACK and without RST counts as RSTR; results keep that on purpose.
    """
    bit = lambda mask: flags.bitwiseAND(F.lit(mask)) != 0
    tcp = (
        F.when(bit(0x04), FLAG_CODES["RSTO"])
        .when(bit(0x14), FLAG_CODES["RSTR"])
        .when(bit(0x02), FLAG_CODES["S0"])
        .otherwise(FLAG_CODES["SF"])
    )
    icmp = F.when(icmp_type == 0, FLAG_CODES["SF"]).otherwise(FLAG_CODES["S0"])
    return F.when(protocol == 6, tcp).when(protocol == 1, icmp).otherwise(FLAG_CODES["SF"])


def protocol_name(number: Column, other: str) -> Column:
    return F.coalesce(lookup(number, IP_PROTOCOLS), F.lit(other))


def packet_features(packets: DataFrame, seconds: int = 2) -> DataFrame:
    """The fifteen connection features of every packet."""
    counted = trailing_count(packets, seconds)
    protocol = F.col("ip_protocol")
    port = F.when(protocol.isin(6, 17), F.col("dst_port")).otherwise(0)
    service = F.coalesce(lookup(port, PORT_SERVICES), F.lit("private"))
    flag = flag_code(protocol, F.col("tcp_flags"), F.col("icmp_type"))
    zero = F.lit(0)
    when_flag = lambda name: F.when(F.col("flag") == FLAG_CODES[name], 1.0).otherwise(0.0)
    coded = counted.withColumn("flag", flag)
    return coded.select(
        "event_id",
        "ts",
        "src",
        zero.alias("duration"),
        F.coalesce(lookup(protocol_name(protocol, "other"), PROTOCOL_CODES), F.lit(1)).alias("protocol_type"),
        lookup(service, SERVICE_CODES).alias("service"),
        "flag",
        F.col("length").alias("src_bytes"),
        *[zero.alias(c) for c in ["dst_bytes", "wrong_fragment", "hot", "logged_in", "num_compromised"]],
        "count",
        F.col("count").alias("srv_count"),
        when_flag("S0").alias("serror_rate"),
        when_flag("S0").alias("srv_serror_rate"),
        when_flag("REJ").alias("rerror_rate"),
    )


def packet_alerts(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One alert row per packet whose attack score reaches the threshold."""
    return scored.filter(F.col("score") >= threshold).select(
        "event_id",
        "ts",
        F.col("src").alias("source"),
        protocol_name(F.col("ip_protocol"), "unknown").alias("protocol"),
        F.col("score").alias("confidence"),
        F.lit("ATTACK").alias("label"),
    )


def newest_alerts(alerts: DataFrame, keep: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def traffic_totals(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Packets, attacks, normal and the attack share; also valid on a stream in complete mode."""
    attack = F.count_if(F.col("score") >= threshold)
    totals = scored.groupBy().agg(F.count("*").alias("packets"), attack.alias("attacks"))
    return totals.select(
        "packets",
        "attacks",
        (F.col("packets") - F.col("attacks")).alias("normal"),
        (F.col("attacks") / F.greatest("packets", F.lit(1)) * 100).alias("attack_percent"),
    )


TUPLE = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]


def with_conversation(packets: DataFrame) -> DataFrame:
    """Adds the endpoint pair in a fixed order, so that both directions share one key."""
    one = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    two = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(one, two), F.greatest(one, two)
    return packets.select(
        "*",
        low.ip.alias("ip_a"),
        low.port.alias("port_a"),
        high.ip.alias("ip_b"),
        high.port.alias("port_b"),
        (one == low).alias("_a_sends"),
    )


#: A gap longer than this (seconds) parts two active periods of a flow.
ACTIVITY_SECONDS = 5.0
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def build_flows(
    packets: DataFrame,
    idle_seconds: float,
    active_seconds: float,
    seq: str = "event_id",
    ts: str = "ts",
    activity_seconds: float = ACTIVITY_SECONDS,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Bidirectional flows of packets that arrive in time order, with every measured feature.

    A flow ends after `idle_seconds` without a packet and is reported in parts of `active_seconds`,
    so a flood shows while it runs. The sender of a flow's first packet is its forward side. A gap
    inside a flow counts for the part of the packet that ends it; if it is longer than
    `activity_seconds` it is an idle one, and the active period before it counts there too, if it is
    longer than an instant. First windows are those of the part (`tcp_window`, -1 for none).

    Gaps and openers come from one blocked scan, so even one endless conversation is cut into blocks.
    """
    idle, active, pause = (int(x * SECOND) for x in (idle_seconds, active_seconds, activity_seconds))
    rows = with_conversation(packets).withColumn("_us", micros(ts))
    rows = rows.withColumn("_block", id_block(F.col(seq), block_bits))
    us, a = F.col("_us"), F.col("_a_sends")
    last = lambda value: Measure("max", value, inclusive=False)
    opener = F.struct(F.col(seq).alias("id"), us.alias("us"), a.alias("a_sends"))
    rows = running_sessions(
        rows,
        TUPLE,
        "_block",
        [seq],
        us,
        {"_flow": Opener(idle, opener), "_since": Opener(min(idle, pause), us, inclusive=False)},
        {"_last": last(us), "_last_a": last(F.when(a, us)), "_last_b": last(F.when(~a, us))},
    )
    forward = F.col("_a_sends") == F.col("_flow.a_sends")
    same = F.when(F.col("_a_sends"), F.col("_last_a")).otherwise(F.col("_last_b"))
    inside = lambda previous: F.when(previous >= F.col("_flow.us"), (us - previous) / SECOND)
    paused = (F.col("_last") >= F.col("_flow.us")) & (us - F.col("_last") > pause)
    busy = (F.col("_last") - F.greatest("_since", "_flow.us")) / SECOND
    rows = rows.select(
        "*",
        F.col("_flow.id").alias("flow_id"),
        F.floor((us - F.col("_flow.us")) / active).alias("part"),
        forward.alias("_fwd"),
        inside(F.col("_last")).alias("_gap"),
        inside(same).alias("_side_gap"),
        F.when(paused, (us - F.col("_last")) / SECOND).alias("_idle"),
        F.when(paused & (busy > 0), busy).alias("_active"),
    )
    fwd, bwd = F.col("_fwd"), ~F.col("_fwd")
    size, count = F.col("length"), F.lit(1)
    flag = lambda mask, rule=F.lit(True): F.count_if(rule & (F.col("tcp_flags").bitwiseAND(F.lit(mask)) != 0))  # noqa: E731, B008
    side = lambda fn, rule, value: fn(F.when(rule, value))
    or_zero = lambda value: F.coalesce(value, F.lit(0.0))
    window = F.col("tcp_window") if "tcp_window" in packets.columns else F.lit(-1)
    first = lambda rule: F.coalesce(F.min_by(window, F.when(rule & window.isNotNull(), F.col(seq))), F.lit(-1)).cast("long")
    return rows.groupBy("flow_id", "part", *TUPLE).agg(
        ((F.max("_us") - F.min("_us")) / SECOND).alias("flow_duration_s"),
        side(F.count, fwd, count).alias("fwd_packets"),
        side(F.count, bwd, count).alias("bwd_packets"),
        F.coalesce(side(F.sum, fwd, size), F.lit(0)).alias("fwd_bytes"),
        F.coalesce(side(F.sum, bwd, size), F.lit(0)).alias("bwd_bytes"),
        *[
            or_zero(side(fn, rule, size).cast("double")).alias(f"{way}_pkt_len_{name}")
            for way, rule in (("fwd", fwd), ("bwd", bwd))
            for name, fn in (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_samp))
        ],
        *[
            or_zero(fn("_gap")).alias(f"flow_iat_{name}")
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min))
        ],
        *[
            or_zero(side(fn, rule, F.col("_side_gap"))).alias(f"{way}_iat_{name}")
            for way, rule in (("fwd", fwd), ("bwd", bwd))
            for name, fn in (("total", F.sum), ("mean", F.avg))
        ],
        flag(FLAG_BITS["psh"], fwd).alias("fwd_psh_flags"),
        *[flag(mask).alias(f"{name}_flag_count") for name, mask in FLAG_BITS.items()],
        first(fwd).alias("init_win_bytes_fwd"),
        first(bwd).alias("init_win_bytes_bwd"),
        F.avg("length").alias("pkt_len_mean"),
        or_zero(F.stddev_samp("length")).alias("pkt_len_std"),
        or_zero(F.try_divide(side(F.count, bwd, count), side(F.count, fwd, count))).alias("down_up_ratio"),
        or_zero(F.avg("_active")).alias("active_mean"),
        or_zero(F.avg("_idle")).alias("idle_mean"),
    )
