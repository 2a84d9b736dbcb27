"""The tables of fixtures.py as DuckDB common table expressions."""

from __future__ import annotations

from flowloom.registry import BANDS, FEATURES, LABELS, RARE_LABELS, STATUSES


def listing(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def severity(risk: str) -> str:
    arms = " ".join(f"when {risk} <= {top} then '{name}'" for name, top in BANDS[:-1])
    return f"case {arms} else '{BANDS[-1][0]}' end"


def rank(risk: str) -> str:
    arms = " ".join(f"when {risk} <= {top} then {i}" for i, (_, top) in enumerate(BANDS[:-1]))
    return f"case {arms} else 3 end"


SRC = "'198.51.100.' || cast(user_id % 254 + 1 as varchar)"

EV = "ev as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"

DET = f"""det0 as (
  select *, cast(floor(value * 100) as bigint) as packet_count, cast(k % 20 as double) / 10 as duration from ev
), det as (
  select event_id, cast(event_id as varchar) as stream_id, ts, {SRC} as src_ip,
    '203.0.113.' || cast(k % 8 + 1 as varchar) as dst_ip,
    cast(1024 + event_id * 7919 % 64512 as integer) as src_port,
    case k % 4 when 0 then 80 when 1 then 443 when 2 then 22 end as dst_port,
    case k % 3 when 0 then 'tcp' when 1 then 'udp' else 'icmp' end as protocol,
    packet_count, packet_count * 60 as byte_count, duration,
    case when duration = 0 then 0.0 else packet_count / duration end as packets_per_sec,
    case when duration = 0 then 0.0 else packet_count * 60 / duration end as bytes_per_sec,
    case event_type when 'click' then 'benign' when 'view' then 'portscan' when 'signup' then 'bruteforce'
      when 'purchase' then 'botnet' else 'ddos' end as label,
    0.5::double + value / 1000 as confidence,
    cast(case when event_type = 'click' then 0 when value > 100 then 100 else floor(value) end as integer)
      as risk_score,
    'm' || cast(event_id % 2 as varchar) as model_version
  from det0
)"""

ASSIGNED = """raised as (select * from det where label <> 'benign' and risk_score >= 31),
seen as (
  select *, max(ts) over (partition by label, dst_ip order by event_id
    rows between unbounded preceding and 1 preceding) as seen from raised
), assigned as (
  select * exclude (seen), max(case when seen is null or ts > seen + interval 360 minute then event_id end)
    over (partition by label, dst_ip order by event_id) as alert_id
  from seen
)"""

STATUS = "case {n} % 5 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATUSES)) + " end"

ROLLED = f"""rolled as (
  select alert_id, label as attack_type,
    arg_max(src_ip, risk_score * 1000000000000 - event_id) as source_ip, dst_ip as destination_ip,
    arg_min(struct_pack(p := dst_port), event_id).p as destination_port,
    arg_min(protocol, event_id) as protocol, min(ts) as first_seen_at, max(ts) as last_seen_at,
    count(*) as detection_count, max(packets_per_sec) as peak_packets_per_sec,
    max(bytes_per_sec) as peak_bytes_per_sec, max(confidence) as confidence,
    max(risk_score) as risk_score, {severity("max(risk_score)")} as severity,
    arg_max(model_version, risk_score * 1000000000000 - event_id) as model_version
  from assigned group by alert_id, label, dst_ip
), alerts as (
  select *, {STATUS.format(n="alert_id")} as status,
    case when alert_id % 7 <> 0 then alert_id % 150 end as assigned_to_id,
    case when alert_id % 5 <> 0 then alert_id % 140 end as acknowledged_by_id
  from rolled
)"""

USERS = """users as (
  select distinct user_id as id, 'u' || cast(user_id as varchar) as username,
    case user_id % 3 when 0 then 'viewer' when 1 then 'analyst' else 'admin' end as role,
    user_id % 10 <> 0 as is_active
  from events
)"""

AUDIT = f"""audit as (
  select event_id as id, ts, 'u' || cast(user_id as varchar) as actor,
    case event_type when 'click' then 'auth.login' when 'view' then 'auth.logout' when 'signup' then 'user.created'
      when 'purchase' then 'alert.status_changed' else 'auth.login_failed' end as action,
    case when event_type = 'purchase' then 'alert' else 'user' end as entity_type,
    cast(k as varchar) as entity_id, {SRC} as ip
  from ev
)"""

NOTES = """notes as (
  select event_id as id, alert_id, event_id % 150 as author_id, '  note ' || cast(event_id as varchar) as body,
    ts as created_at
  from assigned where event_id % 4 = 0
)"""


def _source(n: int, f) -> str:
    if f.source == "Flow Duration":
        return "(q * 4 + m - 1) * 250000"
    if f.source == "Total Fwd Packets":
        return "q * 7 + g"
    return f"(q * {n + 3} + m * {n + 1}) % 997"


def _measured() -> str:
    parts = []
    for n, f in enumerate(FEATURES, 1):
        if f.source:
            scale = "" if f.scale == 1.0 else " * 1e-6::double"
            parts.append(f"cast({_source(n, f)} as double){scale} as {f.name}")
    return ",\n    ".join(parts)


CLASS = "case label_text " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items()) + " end"

FLOWS = f"""raw0 as (
  select event_id as capture_order, 'day' || cast(day(ts) % 3 as varchar) || '.csv' as source_file,
    case when event_id % 211 = 0 then 'Infiltration' when event_type = 'click' then 'BENIGN'
      when event_type = 'view' then 'PortScan' when event_type = 'signup' then 'FTP-Patator'
      when event_type = 'purchase' then 'Web Attack – XSS' when event_id % 2 = 0 then 'DDoS' else 'DoS Hulk'
      end as raw_label,
    cast(floor(value / 5) as bigint) as q, k % 20 as m,
    case when event_id % 50 = 0 then 0 when event_type = 'click' then 1 when event_type = 'view' then 2
      when event_type = 'signup' then 3 when event_type = 'purchase' then 4 else 5 + event_id % 2 end as g
  from ev
), measured as (
  select capture_order, source_file, raw_label,
    trim(regexp_replace(lower(raw_label), '[^a-z0-9]+', ' ', 'g')) as label_text,
    {_measured()}
  from raw0
), featured as (
  select *,
    case when flow_duration_s > 0 then (fwd_bytes + bwd_bytes) / flow_duration_s else 0 end as flow_bytes_per_s,
    case when flow_duration_s > 0 then (fwd_packets + bwd_packets) / flow_duration_s else 0 end
      as flow_packets_per_s
  from measured
)"""

NAMES = ", ".join(f.name for f in FEATURES)

CLEANED = f"""valid as (
  select *, {CLASS} as label from featured
  where label_text not in ({listing(RARE_LABELS)}) and flow_duration_s >= 0
), deduped as (
  select * from valid
  qualify row_number() over (partition by {NAMES}, label order by source_file, capture_order) = 1
), cleaned as (
  select source_file, capture_order, source_file || '|' || label_text as grp, label, {NAMES} from deduped
  qualify count(*) over (partition by {NAMES}) = 1
)"""

SPLIT = """placed as (
  select source_file, capture_order, grp, label,
    row_number() over (partition by grp order by capture_order) - 1 as position,
    count(*) over (partition by grp) as group_size
  from cleaned
), split as (
  select *, position < floor(group_size * 0.7::double) as is_train,
    cast(least(floor(position / greatest(floor(group_size * 0.7::double), 1) * 5), 4) as integer) as fold
  from placed
)"""

_CLASSES = {"click": 0, "view": 1, "signup": 2, "purchase": 3, "error": 4}
SCORED = f"""scored0 as (
  select event_id, k, case event_type {" ".join(f"when '{n}' then {c}" for n, c in _CLASSES.items())} end as y
  from ev
), scored1 as (
  select event_id, y, {", ".join(
      f"(event_id * {2 * c + 3} + k * {c + 1}) % 101 + case when y = {c} then 40 else 0 end as s{c}" for c in range(5)
  )} from scored0
), scored as (
  select event_id, y, {", ".join(f"s{c} / (s0 + s1 + s2 + s3 + s4)::double as p{c}" for c in range(5))},
    case greatest(s0, s1, s2, s3, s4) {" ".join(f"when s{c} then {c}" for c in range(5))} end as pred
  from scored1
)"""

ACTIONS = f"""actions as (
  select event_id as seq, k as alert_id, case when event_id % 7 = 0 then 'acknowledge' else 'status' end as action,
    case when event_id % 7 = 0 then 'INVESTIGATING' else {STATUS.format(n="event_id")} end as status, user_id, ts
  from ev
)"""

PACKETS = """packets as (
  select event_id, ts, user_id as src, case k % 4 when 0 then 6 when 1 then 17 when 2 then 1 else 47 end as ip_protocol,
    cast(k % 32 as integer) as tcp_flags,
    case event_id % 13 when 0 then 20 when 1 then 21 when 2 then 22 when 3 then 23 when 4 then 25 when 5 then 53
      when 6 then 80 when 7 then 110 when 8 then 143 when 9 then 443 when 10 then 8080 when 11 then 8443
      else 9999 end as dst_port,
    cast(k % 9 as integer) as icmp_type, 40 + cast(floor(value * 10) as bigint) as length, value
  from ev
)"""


def query(parts: list[str], body: str) -> str:
    return "with " + ",\n".join([EV, *parts]) + "\n" + body


ALERTS = [DET, ASSIGNED, ROLLED]
