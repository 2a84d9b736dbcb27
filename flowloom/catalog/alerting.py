"""Queries over correlated alerts, the analyst workflow and the detection contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.functions.alerts import advice, description, severity
from flowloom.operators import correlate, workflow
from flowloom.registry import ADVICE, CRITICAL_PREFIX, OTHER_ADVICE, TITLES
from flowloom.sources.settings import in_force


@register(q.query([q.DET, q.ASSIGNED], "select event_id, alert_id from assigned"))
def alert_sessions(spark, d):
    return correlate.links(fx.assigned(spark, d))


@register(
    q.query(
        [
            q.DET,
            """late as (
  select *, event_id + 40 * (event_id % 7) as seq2 from det where label <> 'benign' and risk_score >= 31
), late_seen as (
  select *, max(ts) over (partition by label, dst_ip order by seq2, event_id
    rows between unbounded preceding and 1 preceding) as seen from late
), late_open as (
  select *, case when seen is null or ts > seen + interval 360 minute then 1 else 0 end as opens from late_seen
), late_group as (
  select *, sum(opens) over (partition by label, dst_ip order by seq2, event_id
    rows between unbounded preceding and current row) as grp from late_open
)""",
        ],
        "select event_id, first_value(event_id) over (partition by label, dst_ip, grp order by seq2, event_id) as alert_id from late_group",
    )
)
def alert_sessions_late(spark, d):
    """Arrival order differs from event time, so late detections join the newest alert."""
    seq = F.col("event_id") + 40 * (F.col("event_id") % 7)
    late = fx.detections(spark, d).withColumn("seq2", seq)
    return correlate.links(correlate.assign_alerts(late, fx.ALERT_WINDOW, order=["seq2", "event_id"]))


VERSIONS = """versions as (
  select epoch(hour)::bigint as version, valid_from, n % 60 as min_risk, k % 1500 as window_minutes
  from (select time_bucket(interval 1 hour, ts, timestamp '2000-01-01') as hour, min(ts) as valid_from, count(*) as n, max(k) as k from ev group by 1)
  where hour >= (select min(ts) + interval 1 day from ev) and k % 1500 between 1 and 1440
), held as (
  select d.*, coalesce(version, 0) as settings_version, coalesce(min_risk, 31) as min_risk, coalesce(window_minutes, 15) as window_minutes
  from det d asof left join versions v on d.ts >= v.valid_from
)"""


@register(q.query([q.DET, VERSIONS], "select event_id, settings_version, min_risk, window_minutes from held"))
def detections_with_settings(spark, d):
    """Every detection beside the settings in force when it came; versions that break the contract are passed over."""
    held = in_force(fx.detections(spark, d), fx.settings_versions(spark, d))
    return held.select("event_id", "settings_version", *[F.col(f"_config.{c}").cast("long").alias(c) for c in ("min_risk", "window_minutes")])


@register(
    q.query(
        [
            q.DET,
            VERSIONS,
            """held_raised as (select * from held where label <> 'benign' and risk_score >= min_risk
), held_seen as (
  select *, max(ts) over (partition by label, dst_ip order by event_id rows between unbounded preceding and 1 preceding) as seen from held_raised
)""",
        ],
        """select event_id, settings_version, max(case when seen is null or ts > seen + to_minutes(window_minutes) then event_id end)
  over (partition by label, dst_ip order by event_id) as alert_id from held_seen""",
    )
)
def alerts_under_settings(spark, d):
    """Alerts of a replay in which threshold and window change every hour."""
    found = correlate.assign_under_settings(fx.detections(spark, d), fx.settings_versions(spark, d))
    return found.select("event_id", "settings_version", "alert_id")


ROLL = [
    "alert_id", "attack_type", "source_ip", "destination_ip", "protocol", "first_seen_at", "last_seen_at",
    "detection_count", "risk_score", "severity", "model_version",
]
ROLL_ROUND = ["peak_packets_per_sec", "peak_bytes_per_sec", "confidence"]


@register(
    q.query(
        q.ALERTS,
        f"""select {", ".join(ROLL)}, coalesce(destination_port, -1) as port,
  {", ".join(f"round({c}, 6) as {c}" for c in ROLL_ROUND)} from rolled""",
    )
)
def alert_rollup(spark, d):
    return correlate.rollup(fx.assigned(spark, d)).select(
        *ROLL,
        F.coalesce("destination_port", F.lit(-1)).alias("port"),
        *[F.round(c, 6).alias(c) for c in ROLL_ROUND],
    )


@register(
    q.query(
        [
            q.DET,
            q.ASSIGNED,
            """topped as (
  select *, max(risk_score) over (partition by alert_id order by event_id
    rows between unbounded preceding and 1 preceding) as top from assigned
)""",
        ],
        f"""select alert_id, event_id, {q.severity("top")} as before_severity, {q.severity("risk_score")} as after_severity,
  risk_score from topped where risk_score > top and {q.rank("risk_score")} > {q.rank("top")}""",
    )
)
def alert_escalations(spark, d):
    return correlate.escalations(correlate.rollup(fx.assigned(spark, d)))


@register(
    q.query(
        [q.DET, q.ASSIGNED],
        """select event_id, alert_id, case when event_id = alert_id then 'alert.new' else 'alert.updated' end as type,
  label, dst_ip, risk_score from assigned""",
    )
)
def alert_feed(spark, d):
    return correlate.change_feed(fx.assigned(spark, d))


def _filled(text: str) -> str:
    return f"replace(replace('{text}', '{{src}}', src_ip), '{{dst}}', dst_ip)"


TITLE = (
    "case label "
    + " ".join(f"when '{k}' then '{v}'" for k, v in TITLES.items())
    + " else upper(substr(replace(label, '_', ' '), 1, 1)) || lower(substr(replace(label, '_', ' '), 2)) end"
)
TEXT = "case label " + " ".join(f"when '{k}' then {_filled(v)}" for k, v in ADVICE.items())
TEXT += f" else {_filled(OTHER_ADVICE)} end"


@register(
    q.query(
        [q.DET],
        f"""select event_id, {q.severity("risk_score")} as severity,
  {TITLE} || ' detected — confidence ' || format('{{:.1f}}', confidence * 100) || '% — target ' || dst_ip ||
    case when coalesce(dst_port, 0) <> 0 then ':' || cast(dst_port as varchar) else '' end as description,
  case when risk_score > 80 then '{CRITICAL_PREFIX}' else '' end || {TEXT} as advice
from det""",
    )
)
def alert_texts(spark, d):
    band = severity(F.col("risk_score"))
    return fx.detections(spark, d).select(
        "event_id",
        band.alias("severity"),
        description(F.col("label"), F.col("confidence"), F.col("dst_ip"), F.col("dst_port")).alias("description"),
        advice(F.col("label"), band, F.col("src_ip"), F.col("dst_ip")).alias("advice"),
    )


@register(
    q.query(
        [
            q.DET,
            q.ASSIGNED,
            """topped as (
  select *, max(risk_score) over (partition by alert_id order by event_id
    rows between unbounded preceding and 1 preceding) as top from assigned
)""",
        ],
        f"""select 'alert.created' as action, cast(alert_id as varchar) as entity_id, '' as before_band,
  {q.severity("risk_score")} as after_band, risk_score from topped where event_id = alert_id
union all
select 'alert.escalated', cast(alert_id as varchar), {q.severity("top")}, {q.severity("risk_score")}, risk_score
from topped where risk_score > top and {q.rank("risk_score")} > {q.rank("top")}""",
    )
)
def system_audit(spark, d):
    alerts = correlate.rollup(fx.assigned(spark, d))
    field = lambda c, k: F.coalesce(F.get_json_object(c, f"$.{k}"), F.lit(""))
    return correlate.system_audit(alerts, correlate.escalations(alerts)).select(
        "action",
        "entity_id",
        field("before", "severity").alias("before_band"),
        field("after", "severity").alias("after_band"),
        field("after", "risk_score").cast("int").alias("risk_score"),
    )


REPLAYED = """steps as (
  select *, row_number() over (partition by alert_id order by seq) as n from actions
), replayed as (
  with recursive walk as (
    select alert_id, 0::bigint as n, 'NEW' as after, 'NEW' as before, 0::bigint as seq from (select distinct alert_id from steps)
    union all
    select s.alert_id, s.n, case
      when s.action = 'acknowledge' and w.after <> 'NEW' then w.after
      when w.after = 'NEW' and s.status in ('INVESTIGATING', 'FALSE_POSITIVE') then s.status
      when w.after = 'INVESTIGATING' and s.status in ('CONTAINED', 'RESOLVED', 'FALSE_POSITIVE') then s.status
      when w.after = 'CONTAINED' and s.status in ('INVESTIGATING', 'RESOLVED') then s.status
      when w.after in ('RESOLVED', 'FALSE_POSITIVE') and s.status = 'INVESTIGATING' then s.status
      else w.after end, w.after, s.seq
    from walk w join steps s on s.alert_id = w.alert_id and s.n = w.n + 1
  )
  select s.*, w.before, w.after, w.before <> w.after as applied from walk w join steps s on s.seq = w.seq and w.n > 0
)"""


def replayed(spark, d):
    return workflow.replay(fx.actions(spark, d))


@register(
    q.query([q.ACTIONS, REPLAYED], "select seq, alert_id, action, status, before, after, applied from replayed")
)
def workflow_replay(spark, d):
    return replayed(spark, d).select("seq", "alert_id", "action", "status", "before", "after", "applied")


@register(
    q.query(
        [q.ACTIONS, REPLAYED],
        """select alert_id, coalesce(arg_max(after, seq) filter (applied), 'NEW') as status,
  coalesce(arg_min(user_id, seq) filter (applied), -1) as acknowledged_by_id, min(ts) filter (applied) as acknowledged_at,
  case when arg_max(after, seq) filter (applied) in ('RESOLVED', 'FALSE_POSITIVE') then max(ts) filter (applied) end as resolved_at,
  count(*) filter (applied) as applied, count(*) filter (not applied) as rejected
from replayed group by 1""",
    )
)
def workflow_state(spark, d):
    found = workflow.current_state(replayed(spark, d))
    return found.withColumn("acknowledged_by_id", F.coalesce("acknowledged_by_id", F.lit(-1)))


@register(
    q.query(
        [q.ACTIONS, REPLAYED],
        """select seq, ts, user_id as actor_id, case when action = 'acknowledge' then 'alert.acknowledged' else 'alert.status_changed' end as action,
  cast(alert_id as varchar) as entity_id, '{"status":"' || before || '"}' as before,
  '{"status":"' || after || '","note":false}' as after from replayed where applied""",
    )
)
def workflow_audit(spark, d):
    return workflow.audit_rows(replayed(spark, d)).drop("entity_type")


@register(
    q.query([q.ACTIONS, REPLAYED], "select seq, alert_id, before, status, action from replayed where not applied")
)
def workflow_refused(spark, d):
    return workflow.refused(replayed(spark, d))


REQUESTS = """requests as (
  select event_id as seq, alert_id, case when event_id % 11 <> 0 then event_id % 150 end as user_id from assigned
), decided as (
  select r.*, r.user_id is null or coalesce(u.is_active and u.role <> 'viewer', false) as accepted
  from requests r left join users u on u.id = r.user_id
)"""


def decided(spark, d):
    i = F.col("event_id")
    requests = fx.assigned(spark, d).select(i.alias("seq"), "alert_id", F.when(i % 11 != 0, i % 150).alias("user_id"))
    return workflow.assignments(requests, fx.users(spark, d))


@register(
    q.query(
        [q.DET, q.ASSIGNED, q.USERS, REQUESTS],
        "select seq, alert_id, coalesce(user_id, -1) as user_id, accepted from decided",
    )
)
def assignment_decisions(spark, d):
    return decided(spark, d).withColumn("user_id", F.coalesce("user_id", F.lit(-1))).select(
        "seq", "alert_id", "user_id", "accepted"
    )


@register(
    q.query(
        [q.DET, q.ASSIGNED, q.USERS, REQUESTS],
        """select alert_id, arg_max(coalesce(user_id, -1), seq) as assigned_to_id from decided where accepted group by 1""",
    )
)
def current_assignee(spark, d):
    found = workflow.current_assignee(decided(spark, d))
    return found.withColumn("assigned_to_id", F.coalesce("assigned_to_id", F.lit(-1)))


@register(
    q.query(
        [q.DET, q.ASSIGNED, q.NOTES],
        """select author_id as actor_id, 'alert.note_added' as action, 'alert' as entity_type, cast(alert_id as varchar) as entity_id,
  '{"note_id":' || cast(id as varchar) || '}' as after from notes where length(trim(body)) between 1 and 5000""",
    )
)
def note_audit(spark, d):
    return workflow.note_audit(workflow.add_notes(fx.notes(spark, d)))
