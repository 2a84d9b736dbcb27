"""Queries over packets, connection records, risk signals and cross-flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.functions.flows import from_records
from flowloom.operators import logins, packets, records, risk
from flowloom.registry import FEATURE_NAMES, PORT_SERVICES, SERVICE_CODES

TRAILING = """counted as (
  select p.*, count(*) over (partition by src order by ts range between interval 2 second preceding and current row)
    - count(*) over (partition by src, ts) + row_number() over (partition by src, ts order by event_id) as count
  from packets p
)"""


@register(q.query([q.PACKETS, TRAILING], "select event_id, src, count from counted"))
def source_trailing_count(spark, d):
    return packets.trailing_count(fx.packets(spark, d)).select("event_id", "src", "count")


@register(
    q.query(
        [q.PACKETS, TRAILING.replace("interval 2 second", "interval 12 hour")],
        "select event_id, src, count from counted",
    )
)
def source_trailing_count_half_day(spark, d):
    """The same operator with a window wide enough to hold many packets."""
    return packets.trailing_count(fx.packets(spark, d), 43200).select("event_id", "src", "count")


CODES = "case case when ip_protocol in (6, 17) then dst_port else 0 end " + " ".join(
    f"when {port} then {SERVICE_CODES[name]}" for port, name in PORT_SERVICES.items()
)

CODED = f"""coded as (
  select *, case when ip_protocol = 1 then 0 when ip_protocol = 17 then 2 else 1 end as protocol_type,
    {CODES} else 47 end as service,
    case when ip_protocol = 6 then case when tcp_flags & 4 <> 0 then 2 when tcp_flags & 20 <> 0 then 4
        when tcp_flags & 2 <> 0 then 5 else 9 end
      when ip_protocol = 1 then case when icmp_type = 0 then 9 else 5 end else 9 end as flag
  from counted
)"""


@register(
    q.query(
        [q.PACKETS, TRAILING, CODED],
        """select event_id, ts, src, 0 as duration, protocol_type, service, flag, length as src_bytes, 0 as dst_bytes,
  0 as wrong_fragment, 0 as hot, 0 as logged_in, 0 as num_compromised, count, count as srv_count,
  case when flag = 5 then 1.0::double else 0 end as serror_rate,
  case when flag = 5 then 1.0::double else 0 end as srv_serror_rate, 0.0::double as rerror_rate from coded""",
    )
)
def packet_features(spark, d):
    return packets.packet_features(fx.packets(spark, d))


SCORE = "least(value / 200, 1.0::double)"


def scored_packets(spark, d):
    return fx.packets(spark, d).withColumn("score", F.least(F.col("value") / 200, F.lit(1.0)))


PACKET_ALERTS = q.query(
    [q.PACKETS],
    f"""select event_id, ts, src as source, case ip_protocol when 6 then 'tcp' when 17 then 'udp' when 1 then 'icmp'
  else 'unknown' end as protocol, round({SCORE}, 6) as confidence, 'ATTACK' as label from packets where {SCORE} >= 0.5""",
)


@register(PACKET_ALERTS)
def packet_alerts(spark, d):
    return packets.packet_alerts(scored_packets(spark, d)).withColumn("confidence", F.round("confidence", 6))


@register(
    q.query(
        [q.PACKETS],
        f"select event_id, ts, src as source from packets where {SCORE} >= 0.5 order by ts desc, event_id desc limit 100",
    )
)
def newest_packet_alerts(spark, d):
    alerts = packets.packet_alerts(scored_packets(spark, d))
    return packets.newest_alerts(alerts).select("event_id", "ts", "source")


@register(
    q.query(
        [q.PACKETS],
        f"""select count(*) as packets, count(case when {SCORE} >= 0.5 then 1 end) as attacks,
  count(case when {SCORE} < 0.5 then 1 end) as normal,
  round(count(case when {SCORE} >= 0.5 then 1 end) / greatest(count(*), 1)::double * 100, 6) as attack_percent from packets""",
    )
)
def traffic_totals(spark, d):
    found = packets.traffic_totals(scored_packets(spark, d))
    return found.withColumn("attack_percent", F.round("attack_percent", 6))


CONN = """conn as (select src_ip, src_port, dst_ip, dst_port, protocol, event_id, ts, tcp_flags, tcp_window, length from (
  select event_id, ts, case when k % 5 > 0 then event_id * 131 % 65536 end as tcp_window, cast(k % 32 as integer) as tcp_flags, 40 + cast(floor(value * 10) as bigint) as length,
    case when event_id % 3 = 0 then b else a end as src_ip, case when event_id % 3 = 0 then 443 else 40000 + user_id % 3 end as src_port,
    case when event_id % 3 = 0 then a else b end as dst_ip, case when event_id % 3 = 0 then 40000 + user_id % 3 else 443 end as dst_port,
    6 as protocol
  from (select *, '198.51.100.' || cast(user_id % 254 + 1 as varchar) as a, '203.0.113.' || cast(user_id % 8 + 1 as varchar) as b from ev)
)), keyed as (
  select *, epoch_us(ts) as us, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as e1,
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) as e2 from conn
), gaps as (
  select *, max(us) over (partition by e1, e2 order by event_id rows between unbounded preceding and 1 preceding) as last_us,
    max(us) over (partition by e1, e2, src_ip order by event_id rows between unbounded preceding and 1 preceding) as last_side
  from keyed
), opened as (
  select *, max(case when last_us is null or us > last_us + 21600000000 then event_id end)
    over (partition by e1, e2 order by event_id) as flow_id from gaps
), flowed as (
  select o.*, f.us as first_us, f.src_ip = o.src_ip as fwd, cast(floor((o.us - f.us) / 86400000000.0::double) as bigint) as part
  from opened o join keyed f on f.event_id = o.flow_id
), measured as (
  select *, case when last_us >= first_us then (us - last_us) / 1000000.0::double end as gap,
    case when last_side >= first_us then (us - last_side) / 1000000.0::double end as side_gap from flowed
)"""


def conversations(spark, d, events=None):
    a = F.concat(F.lit("198.51.100."), (F.col("user_id") % 254 + 1).cast("string"))
    b = F.concat(F.lit("203.0.113."), (F.col("user_id") % 8 + 1).cast("string"))
    back, port = F.col("event_id") % 3 == 0, (40000 + F.col("user_id") % 3).cast("int")
    return (fx.events(spark, d) if events is None else events).select(
        "event_id",
        "ts",
        F.when(back, b).otherwise(a).alias("src_ip"),
        F.when(back, 443).otherwise(port).alias("src_port"),
        F.when(back, a).otherwise(b).alias("dst_ip"),
        F.when(back, port).otherwise(443).alias("dst_port"),
        F.lit(6).alias("protocol"),
        (F.col("k") % 32).cast("int").alias("tcp_flags"),
        (F.lit(40) + F.floor(F.col("value") * 10)).cast("long").alias("length"),
        F.when(F.col("k") % 5 > 0, F.col("event_id") * 131 % 65536).alias("tcp_window"),
    )


COUNTED = ["fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_flag_count", "ack_flag_count"]
STATS = [
    "flow_duration_s", "fwd_pkt_len_max", "fwd_pkt_len_mean", "bwd_pkt_len_min", "flow_iat_mean", "flow_iat_max",
    "flow_iat_min", "fwd_iat_total", "bwd_iat_mean", "pkt_len_mean",
]


@register(
    q.query(
        [CONN],
        """select flow_id, part, count(case when fwd then 1 end) as fwd_packets, count(case when not fwd then 1 end) as bwd_packets,
  cast(coalesce(sum(case when fwd then length end), 0) as bigint) as fwd_bytes,
  cast(coalesce(sum(case when not fwd then length end), 0) as bigint) as bwd_bytes,
  count(case when tcp_flags & 2 <> 0 then 1 end) as syn_flag_count, count(case when tcp_flags & 16 <> 0 then 1 end) as ack_flag_count,
  round((max(us) - min(us)) / 1000000.0::double, 9) as flow_duration_s,
  round(coalesce(max(case when fwd then length end), 0)::double, 9) as fwd_pkt_len_max,
  round(coalesce(avg(case when fwd then length end), 0), 9) as fwd_pkt_len_mean,
  round(coalesce(min(case when not fwd then length end), 0)::double, 9) as bwd_pkt_len_min,
  round(coalesce(avg(gap), 0), 9) as flow_iat_mean, round(coalesce(max(gap), 0), 9) as flow_iat_max,
  round(coalesce(min(gap), 0), 9) as flow_iat_min,
  round(coalesce(sum(case when fwd then side_gap end), 0), 9) as fwd_iat_total,
  round(coalesce(avg(case when not fwd then side_gap end), 0), 9) as bwd_iat_mean, round(avg(length), 9) as pkt_len_mean
from measured group by flow_id, part""",
    )
)
def built_flows(spark, d):
    found = packets.build_flows(conversations(spark, d), 21600, 86400)
    return found.select("flow_id", "part", *COUNTED, *[F.round(c, 9).alias(c) for c in STATS])


#: Seconds without a packet that part the active periods of the test flows.
PAUSE = 7200
FLOW_FEATURES = f"""resumed as (
  select *, max(case when last_us is null or us > last_us + {PAUSE * 1000000} then us end)
    over (partition by e1, e2 order by event_id rows between unbounded preceding and 1 preceding) as since_us from measured
), paused as (
  select *, case when gap > {PAUSE} then gap end as idle,
    case when gap > {PAUSE} and last_us > greatest(since_us, first_us) then (last_us - greatest(since_us, first_us)) / 1000000.0::double end as active
  from resumed
), part_features as (
  select flow_id, part, (max(us) - min(us)) / 1000000.0::double as flow_duration_s,
    count(case when fwd then 1 end) as fwd_packets, count(case when not fwd then 1 end) as bwd_packets,
    cast(coalesce(sum(case when fwd then length end), 0) as bigint) as fwd_bytes,
    cast(coalesce(sum(case when not fwd then length end), 0) as bigint) as bwd_bytes,
    {", ".join(f"coalesce({fn}(case when {rule} then length end), 0)::double as {way}_pkt_len_{name}"
               for way, rule in (("fwd", "fwd"), ("bwd", "not fwd"))
               for name, fn in (("max", "max"), ("min", "min"), ("mean", "avg"), ("std", "stddev_samp")))},
    coalesce(avg(gap), 0) as flow_iat_mean, coalesce(stddev_samp(gap), 0) as flow_iat_std,
    coalesce(max(gap), 0) as flow_iat_max, coalesce(min(gap), 0) as flow_iat_min,
    coalesce(sum(case when fwd then side_gap end), 0) as fwd_iat_total, coalesce(avg(case when fwd then side_gap end), 0) as fwd_iat_mean,
    coalesce(sum(case when not fwd then side_gap end), 0) as bwd_iat_total, coalesce(avg(case when not fwd then side_gap end), 0) as bwd_iat_mean,
    count(case when fwd and tcp_flags & 8 <> 0 then 1 end) as fwd_psh_flags,
    {", ".join(f"count(case when tcp_flags & {bit} <> 0 then 1 end) as {name}_flag_count" for name, bit in packets.FLAG_BITS.items())},
    coalesce(arg_min(tcp_window, event_id) filter (fwd and tcp_window is not null), -1) as init_win_bytes_fwd,
    coalesce(arg_min(tcp_window, event_id) filter (not fwd and tcp_window is not null), -1) as init_win_bytes_bwd,
    avg(length) as pkt_len_mean, coalesce(stddev_samp(length), 0) as pkt_len_std,
    coalesce(count(case when not fwd then 1 end) / nullif(count(case when fwd then 1 end), 0)::double, 0) as down_up_ratio,
    coalesce(avg(active), 0) as active_mean, coalesce(avg(idle), 0) as idle_mean
  from paused group by flow_id, part
), rated as (
  select *, case when flow_duration_s > 0 then (fwd_bytes + bwd_bytes) / flow_duration_s else 0 end as flow_bytes_per_s,
    case when flow_duration_s > 0 then (fwd_packets + bwd_packets) / flow_duration_s else 0 end as flow_packets_per_s from part_features
)"""


def digits(feature: str) -> int:
    """Deviations depend on the order of their sums in the last places."""
    return 6 if feature.endswith("_std") else 9


FLOW_FEATURES_SQL = q.query(
    [CONN, FLOW_FEATURES], "select flow_id, part, " + ", ".join(f"round({f}::double, {digits(f)}) as {f}" for f in FEATURE_NAMES) + " from rated"
)


def model_flows(flows):
    rows = from_records(flows, [F.col("flow_id"), F.col("part")])
    return rows.select("flow_id", "part", *[F.round(c, digits(c)).alias(c) for c in FEATURE_NAMES])


@register(FLOW_FEATURES_SQL)
def built_flow_features(spark, d):
    """The model's features of flows built from packets."""
    return model_flows(packets.build_flows(conversations(spark, d), 21600, 86400, activity_seconds=PAUSE))


def connections(spark, d):
    """Connection records with all columns; many rows repeat."""
    k = F.col("k")
    named = {
        "protocol_type": F.element_at(F.array(F.lit("tcp"), F.lit("udp"), F.lit("icmp")), (k % 3 + 1).cast("int")),
        "service": F.concat(F.lit("s"), (k % 4).cast("string")),
        "flag": F.element_at(F.array(F.lit("SF"), F.lit("S0")), (k % 2 + 1).cast("int")),
        "attack": F.when(F.col("event_type") == "click", "normal").otherwise(F.col("event_type")),
        "src_bytes": F.floor(F.col("value") / 40) * 40,
    }
    columns = [
        named.get(c, k * (i + 1) % 5).alias(c) for i, c in enumerate(records_columns())
    ]
    return fx.events(spark, d).select(*columns)


def records_columns():
    from flowloom.registry import CONNECTION_COLUMNS

    return CONNECTION_COLUMNS


_NAMED = {
    "protocol_type": "case k % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end",
    "service": "'s' || cast(k % 4 as varchar)",
    "flag": "case k % 2 when 0 then 'SF' else 'S0' end",
    "attack": "case when event_type = 'click' then 'normal' else event_type end",
    "src_bytes": "cast(floor(value / 40) as bigint) * 40",
}
RECORDS = "records as (select " + ", ".join(
    f"{_NAMED.get(c, f'k * {i + 1} % 5')} as {c}" for i, c in enumerate(records_columns())
) + " from ev)"


@register(
    q.query(
        [RECORDS],
        "select * exclude (attack), case when attack = 'normal' then 'normal' else 'attack' end as attack from (select distinct * from records)",
    )
)
def connection_clean(spark, d):
    return records.clean_records(connections(spark, d))


@register(
    q.query(
        [RECORDS],
        """select service, flag, attack, (dense_rank() over (order by service) - 1)::double as service_code,
  (dense_rank() over (order by flag) - 1)::double as flag_code, (dense_rank() over (order by attack) - 1)::double as attack_code
from records group by 1, 2, 3""",
    )
)
def connection_codes(spark, d):
    rows = connections(spark, d)
    both = rows.withColumns({f"{c}_code": F.col(c) for c in ["service", "flag", "attack"]})
    coded, _ = records.encode_records(both, ["service_code", "flag_code", "attack_code"])
    return coded.select("service", "flag", "attack", "service_code", "flag_code", "attack_code").distinct()


MI_NUMBERS = ["src_bytes", "protocol_type", "service", "flag", "count"]
MI = ["src_bytes", "duration", "protocol_type", "service", "flag", "count"]


def information(spark, d):
    features = packets.packet_features(fx.packets(spark, d))
    kinds = fx.events(spark, d).select("event_id", (F.col("event_type") == "error").alias("attack"))
    return records.mutual_information(features.join(kinds, "event_id"), MI, "attack")


def _bin(f: str) -> str:
    return f"""case when max({f}) over () > min({f}) over () then
    least(floor(({f} - min({f}) over ()) / (max({f}) over () - min({f}) over ())::double * 10), 9) else 0 end"""


INFORMATION = f"""labelled as (
  select src_bytes, duration, protocol_type, service, flag, count, event_type = 'error' as attack from
    (select event_id, length as src_bytes, 0 as duration, protocol_type, service, flag, count from coded)
    join ev using (event_id)
), cells as (
  {" union all ".join(f"select '{f}' as feature, {_bin(f)} as bin, attack from labelled" for f in MI)}
), joint as (
  select feature, bin, attack, count(*)::double as n from cells group by all
), terms as (
  select *, sum(n) over (partition by feature, bin) as n_bin, sum(n) over (partition by feature, attack) as n_label,
    sum(n) over (partition by feature) as n_all from joint
), information as (
  select feature, greatest(sum(n / n_all * ln(n * n_all / (n_bin * n_label))), 0) as score from terms group by 1
)"""


@register(
    q.query(
        [q.PACKETS, TRAILING, CODED, INFORMATION],
        "select feature, round(score, 6) as score from information",
    )
)
def mutual_information(spark, d):
    return information(spark, d).withColumn("score", F.round("score", 6))


@register(
    q.query(
        [q.PACKETS, TRAILING, CODED, INFORMATION],
        "select feature from information order by score desc, feature limit 3",
    )
)
def best_features(spark, d):
    return records.best_features(information(spark, d), 3).select("feature")


def _psi(n: str) -> str:
    """The digamma function of whole numbers: harmonic sums up to 40, a series beyond."""
    return f"""case when {n} <= 40 then coalesce(list_sum(list_transform(range(1, {n}::bigint), lambda i: 1.0::double / i)), 0) - 0.5772156649015329::double
    else ln({n}) - 1 / (2.0::double * {n}) - 1 / (12.0::double * {n} * {n}) + 1 / (120.0::double * pow({n}, 4)) end"""


NEIGHBOURS = f"""labelled as (
  select event_id, src_bytes, protocol_type, service, flag, count, event_type = 'error' as attack from
    (select event_id, length as src_bytes, protocol_type, service, flag, count from coded) join ev using (event_id)
), long as (
  {" union all ".join(f"select '{f}' as feature, {f}::double as value, attack from labelled" for f in MI_NUMBERS)}
), cells as (
  select feature, attack, value, count(*) as n, sum(count(*)) over (partition by feature, attack) as of_label from long group by 1, 2, 3
), far as (
  select a.feature, a.attack, a.value, abs(b.value - a.value) as d,
    sum(sum(b.n - case when b.value = a.value then 1 else 0 end)) over (partition by a.feature, a.attack, a.value order by abs(b.value - a.value)) as upto
  from cells a join cells b on a.feature = b.feature and a.attack = b.attack group by 1, 2, 3, 4
), kth as (
  select feature, attack, value, min(d) filter (upto >= 3) as d from far group by 1, 2, 3
), spread as (
  select k.feature, k.attack, k.value, k.d, any_value(c.n) as n, any_value(c.of_label) as of_label,
    sum(o.n) - case when k.d = 0 then 1 else 0 end as m
  from kth k join cells c using (feature, attack, value)
  join cells o on o.feature = k.feature and (abs(o.value - k.value) < k.d or o.value = k.value) group by 1, 2, 3, 4
), neighbour_information as (
  select feature, greatest({{psi_all}} + sum(n * ({{psi_k}} - {{psi_label}} - {{psi_m}})) / sum(n), 0) as score from spread group by 1
)"""
NEIGHBOURS = NEIGHBOURS.format(psi_all=_psi("sum(n)"), psi_k="case when d = 0 then " + _psi("(n - 1)") + " else 1.5::double - 0.5772156649015329::double end", psi_label=_psi("of_label"), psi_m=_psi("m"))


@register(
    q.query([q.PACKETS, TRAILING, CODED, NEIGHBOURS], "select feature, round(score, 6) as score from neighbour_information")
)
def mutual_information_neighbours(spark, d):
    """Mutual information by nearest neighbours, ties counted."""
    features = packets.packet_features(fx.packets(spark, d))
    kinds = fx.events(spark, d).select("event_id", (F.col("event_type") == "error").alias("attack"))
    found = records.neighbour_information(features.join(kinds, "event_id"), MI_NUMBERS, "attack")
    return found.withColumn("score", F.round("score", 6))


def greedy(rows: str, keys: str, name: str = "starts") -> str:
    """Openers of windows, one after the other: `rows` has the keys, ts and period."""
    same = " and ".join(f"r.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    of = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}({keys}, start_ts) as (
  select {keys}, min(ts) from {rows} group by {keys}
  union all
  select {of}, min(r.ts) from {name} s join {rows} r on {same} and r.ts >= s.start_ts + r.period group by {of}, s.start_ts
)"""


@register(
    q.query(
        [
            q.AUDIT,
            """failed as (select ts, actor, ip from audit where action = 'auth.login_failed'
), scoped as (
  select ts, 'user' as scope, actor as key, interval 1 day as period from failed union all select ts, 'ip', ip, interval 1 day from failed
)""",
            greedy("scoped", "scope, key"),
            """placed as (
  select r.*, (select max(start_ts) from starts s where s.scope = r.scope and s.key = r.key and s.start_ts <= r.ts) as window_start from scoped r
)""",
        ],
        """select window_start, scope, key, count(*) as failures,
  count(*) >= case scope when 'user' then 3 else 4 end as reached from placed group by 1, 2, 3""",
    ).replace("with ", "with recursive ", 1)
)
def failed_login_windows(spark, d):
    found = logins.failed_logins(fx.audit(spark, d), 1440, {"user": 3, "ip": 4})
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register(
    q.query(
        [q.DET],
        """select time_bucket(interval 1 hour, ts, timestamp '2000-01-01') as window_start, dst_ip, count(*) as flows,
  round(count(*) / 3600.0::double, 9) as flows_per_s, count(distinct src_ip) as unique_sources from det group by 1, 2""",
    )
)
def destination_features(spark, d):
    found = risk.destination_features(fx.network_events(spark, d))
    return found.withColumn("flows_per_s", F.round("flows_per_s", 9))


@register(
    q.query(
        [q.DET],
        """select time_bucket(interval 1 hour, ts, timestamp '2000-01-01') as window_start, src_ip, count(*) as flows,
  count(distinct dst_ip) as unique_hosts, count(distinct dst_port) as unique_ports from det group by 1, 2""",
    )
)
def source_features(spark, d):
    return risk.source_features(fx.network_events(spark, d))


def _sql_signal(c: str) -> str:
    mean = f"sum({c}_h * pow(0.7, age)) / sum(pow(0.7, age))"
    z = f"greatest((any_value({c}) - {mean}) / greatest(1.4826 * any_value(mad_{c}), 0.05 * {mean}, 1.0), 0)"
    return f"100 * {z} / ({z} + 3)"


#: Every hour from a destination's first is a row, silent ones with zeros; each is set against the 24 before.
ANOMALY = f"""buckets as (
  select dst_ip, time_bucket(interval 1 hour, ts, timestamp '2000-01-01') as bucket, count(*)::double as flows,
    sum(packet_count)::double as packets, sum(byte_count)::double as bytes from det group by 1, 2
), hours as (
  select dst_ip, unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) as hour from buckets group by 1
), dense as (
  select h.dst_ip, hour, {", ".join(f"coalesce({c}, 0) as {c}_h" for c in risk.RATES)}
  from hours h left join buckets b on b.dst_ip = h.dst_ip and b.bucket = h.hour
), history as (
  select b.*, {", ".join(f"{c}_h" for c in risk.RATES)}, date_diff('hour', hour, bucket) - 1 as age
  from buckets b join dense d on d.dst_ip = b.dst_ip and hour < bucket and hour >= bucket - interval 24 hour
), medians as (
  select dst_ip, bucket, {", ".join(f"median({c}_h) as mid_{c}" for c in risk.RATES)} from history group by 1, 2
), deviations as (
  select dst_ip, bucket, {", ".join(f"median(abs({c}_h - mid_{c})) as mad_{c}" for c in risk.RATES)}
  from history join medians using (dst_ip, bucket) group by 1, 2
), signals as (
  select dst_ip, bucket, greatest({", ".join(_sql_signal(c) for c in risk.RATES)}) as signal
  from history join deviations using (dst_ip, bucket) group by 1, 2
), anomaly as (
  select dst_ip, bucket, coalesce(signal, 0) as traffic_anomaly from buckets left join signals using (dst_ip, bucket)
)"""


@register(
    q.query([q.DET, ANOMALY], "select dst_ip, bucket, round(traffic_anomaly, 4) as traffic_anomaly from anomaly")
)
def traffic_anomaly(spark, d):
    found = risk.traffic_anomaly(fx.network_events(spark, d))
    return found.select("dst_ip", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("traffic_anomaly", 4).alias("traffic_anomaly"))


REPUTATION = """prior as (
  select d.event_id,
    (select count(*) from rolled r where r.source_ip = d.src_ip and r.alert_id < d.event_id) as prior_source,
    (select count(*) from rolled r where regexp_replace(r.source_ip, '[.][0-9]+$', '') = regexp_replace(d.src_ip, '[.][0-9]+$', '')
      and r.alert_id < d.event_id) as prior_subnet
  from det d
)"""


@register(
    q.query([*q.ALERTS, REPUTATION], "select event_id, prior_source, prior_subnet from prior")
)
def source_reputation(spark, d):
    found = risk.source_reputation(fx.detections(spark, d), fx.alerts(spark, d))
    return found.select("event_id", "prior_source", "prior_subnet")


@register(
    q.query(
        [*q.ALERTS, REPUTATION, ANOMALY],
        """select event_id, case when label = 'benign' then 0 else cast(round_even(
    0 + 0.4::double * (confidence * 100) + 0.25::double * coalesce(traffic_anomaly, 0)
    + 0.25::double * (case label when 'ddos' then 90.0::double when 'botnet' then 80.0 when 'bruteforce' then 65.0 when 'portscan' then 50.0 else 0 end
      * (0.5::double + 0.5::double * least(log10(packet_count + 1) / 5, 1.0)))
    + 0.1::double * least(100.0::double, 20.0::double * prior_source + 0.1::double * prior_subnet), 0) as integer) end as risk
from det join prior using (event_id)
left join anomaly a on a.dst_ip = det.dst_ip
  and a.bucket = time_bucket(interval 1 hour, ts, timestamp '2000-01-01') - interval 1 hour""",
    )
)
def risk_score(spark, d):
    return risk.score_detections(fx.detections(spark, d), fx.alerts(spark, d)).select("event_id", "risk")


RULES = {"email": ("HIGH", 86400), "chat": ("MEDIUM", 21600)}


#: The columns of a message sent are to be filled in.
NOTIFIED = q.query(
    [
        q.DET,
        q.ASSIGNED,
        """fits as (
  select 'email' as channel, alert_id, event_id, ts, risk_score, interval 1 day as period from assigned where risk_score > 60
  union all
  select 'chat', alert_id, event_id, ts, risk_score, interval 6 hour from assigned where risk_score > 30
)""",
        greedy("fits", "channel, alert_id"),
        """placed as (
  select f.*, (select max(start_ts) from starts s where s.channel = f.channel and s.alert_id = f.alert_id and s.start_ts <= f.ts) as sent_at
  from fits f
)""",
    ],
    "select {} from placed group by channel, alert_id, sent_at",
).replace("with ", "with recursive ", 1)


@register(
    NOTIFIED.format(
        """channel, alert_id, sent_at, min(event_id) filter (ts = sent_at) as event_id,
  arg_min(risk_score, event_id) filter (ts = sent_at) as risk_score, count(*) - 1 as held_back"""
    )
)
def notifications(spark, d):
    sent = risk.notifications(fx.assigned(spark, d), RULES)
    return sent.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))
