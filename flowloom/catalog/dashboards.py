"""Queries over events, alerts and audit, with the SQL they must equal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from flowloom.catalog import fixtures as fx
from flowloom.catalog import tables_sql as q
from flowloom.catalog.book import register
from flowloom.operators import correlate, lookup
from flowloom.plans import dashboard

def rows(spark, d):
    return dashboard.joined(fx.network_events(spark, d), fx.predictions(spark, d))


def as_of(spark, d):
    return dashboard.latest(fx.table(spark, d, "events"))


RECENT = "ts >= (select max(ts) from events) - interval {}"


@register(
    q.query(
        [q.DET],
        f"""select b.bucket, count(d.event_id) as events, count(case when d.label <> 'benign' then 1 end) as attacks
from (select unnest(generate_series(
    time_bucket(interval 1 hour, max(ts) - interval 7 day, timestamp '2000-01-01'), max(ts), interval 1 hour
  )) as bucket from events) b
left join (select * from det where {RECENT.format("7 day")}) d
  on time_bucket(interval 1 hour, d.ts, timestamp '2000-01-01') = b.bucket
group by 1""",
    )
)
def attack_timeseries(spark, d):
    e, p = fx.network_events(spark, d), fx.predictions(spark, d)
    return dashboard.timeseries(e, p, "7d", "1h", as_of(spark, d))


@register(
    q.query([q.DET], f"select label, count(*) as events from det where {RECENT.format('7 day')} group by 1")
)
def event_distribution(spark, d):
    e, p = fx.network_events(spark, d), fx.predictions(spark, d)
    return dashboard.distribution(e, p, "7d", as_of(spark, d))


@register(
    q.query(
        [q.DET],
        """select time_bucket(interval 1 hour, ts, timestamp '2000-01-01') as bucket, label, count(*) as events,
  cast(sum(packet_count) as bigint) as packets, cast(sum(byte_count) as bigint) as bytes, max(risk_score) as peak_risk
from det group by 1, 2""",
    )
)
def attack_statistics(spark, d):
    return dashboard.attack_statistics(fx.network_events(spark, d), fx.predictions(spark, d))


@register(
    q.query(
        q.ALERTS,
        f"""select s.status, count(a.alert_id) as alerts
from (select unnest([{q.listing(q.STATUSES)}]) as status) s left join alerts a on a.status = s.status group by 1""",
    )
)
def alerts_by_status(spark, d):
    return dashboard.alerts_by_status(fx.alerts(spark, d))


OPEN = "status in ('NEW', 'INVESTIGATING', 'CONTAINED')"


@register(
    q.query(
        q.ALERTS,
        f"""select s.severity, count(a.alert_id) as alerts
from (select unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) as severity) s
left join alerts a on a.severity = s.severity and a.{OPEN} group by 1""",
    )
)
def open_alerts_by_severity(spark, d):
    return dashboard.open_alerts_by_severity(fx.alerts(spark, d))


@register(
    q.query(
        q.ALERTS,
        f"""select * exclude (open_risk), coalesce(open_risk, 0) as risk_score, {q.severity("coalesce(open_risk, 0)")} as severity
from (select count(*) as events, count(case when label <> 'benign' then 1 end) as attacks
  from det where {RECENT.format("1 day")}),
(select count(case when {OPEN} then 1 end) as alerts_open,
  {", ".join(f"count(case when status = '{s}' then 1 end) as status_{s.lower()}" for s in q.STATUSES)},
  {", ".join(f"count(case when {OPEN} and severity = '{s}' then 1 end) as open_{s.lower()}" for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL"))},
  max(case when {OPEN} then risk_score end) as open_risk from alerts)""",
    )
)
def stats_summary(spark, d):
    e, p = fx.network_events(spark, d), fx.predictions(spark, d)
    return dashboard.summary(e, p, fx.alerts(spark, d), "24h", as_of(spark, d))


@register(
    "select strftime(ts, '%Y-%m-%d') as day, count(*) as events from events group by 1, cast(ts as date) "
    "having cast(ts as date) < cast((select max(ts) from events) - interval 20 day as date)"
)
def expired_days(spark, d):
    found = dashboard.expired_days(fx.table(spark, d, "events"), 20, as_of(spark, d))
    return found.select(F.col("day").cast("string").alias("day"), "events")


EVENT_OUT = [
    "event_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count",
    "label", "risk_score",
]
EVENT_WHERE = """label = 'ddos' and (src_ip = '203.0.113.3' or dst_ip = '203.0.113.3') and risk_score >= 20
  and ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-28'"""


def filtered_events(spark, d):
    return lookup.filter_events(
        rows(spark, d),
        label="ddos",
        ip="203.0.113.3",
        since=datetime(2024, 1, 3),
        until=datetime(2024, 1, 28),
        min_risk=20,
    )


@register(
    q.query(
        [q.DET],
        f"""select {", ".join(EVENT_OUT)}, {q.severity("risk_score")} as severity,
  round(confidence, 6) as confidence, round(packets_per_sec, 6) as packets_per_sec
from det where {EVENT_WHERE} order by ts desc, event_id desc limit 50 offset 10""",
    )
)
def event_page(spark, d):
    return lookup.newest_events(filtered_events(spark, d), 50, 10).select(
        *EVENT_OUT,
        correlate.severity(F.col("risk_score")).alias("severity"),
        F.round("confidence", 6).alias("confidence"),
        F.round("packets_per_sec", 6).alias("packets_per_sec"),
    )


@register(q.query([q.DET], f"select count(*) as total from det where {EVENT_WHERE}"))
def event_filter_total(spark, d):
    return lookup.total(filtered_events(spark, d))


@register(
    q.query(
        [q.DET, q.ASSIGNED],
        """select d.event_id, d.ts, d.label, d.risk_score, a.alert_id from det d
join assigned a using (event_id) where a.alert_id = (select min(alert_id) from assigned)""",
    )
)
def events_of_first_alert(spark, d):
    links = correlate.links(fx.assigned(spark, d))
    first = links.agg(F.min("alert_id")).first()[0]
    return lookup.events_of_alert(rows(spark, d), links, first).select(
        "event_id", "ts", "label", "risk_score", "alert_id"
    )


@register(
    q.query(
        [q.DET, q.ASSIGNED],
        "select d.event_id, d.ts, coalesce(a.alert_id, -1) as alert_id from det d left join assigned a using (event_id)",
    )
)
def event_alerts(spark, d):
    found = lookup.event_alerts(fx.network_events(spark, d), correlate.links(fx.assigned(spark, d)))
    return found.withColumn("alert_id", F.coalesce("alert_id", F.lit(-1)))


@register(q.query([q.DET], "select event_id, ts, src_ip, label, risk_score from det where event_id = 77"))
def event_by_id(spark, d):
    return lookup.one(rows(spark, d), "event_id", 77).select("event_id", "ts", "src_ip", "label", "risk_score")


ALERT_OUT = [
    "alert_id", "attack_type", "source_ip", "destination_ip", "protocol", "first_seen_at", "last_seen_at",
    "detection_count", "risk_score", "severity",
]


def port():
    return F.coalesce("destination_port", F.lit(-1)).alias("port")


@register(
    q.query(
        [*q.ALERTS, q.USERS],
        f"""select {", ".join("a." + c for c in ALERT_OUT)}, coalesce(a.destination_port, -1) as port, status, u.username as assigned_to
from alerts a left join users u on u.id = a.assigned_to_id
where {OPEN} and severity in ('HIGH', 'CRITICAL') and last_seen_at >= timestamp '2024-01-05'
  and first_seen_at <= timestamp '2024-01-25'
order by a.risk_score desc, a.last_seen_at desc, a.alert_id desc limit 100 offset 20""",
    )
)
def alert_page_by_risk(spark, d):
    found = lookup.filter_alerts(
        fx.alerts(spark, d),
        statuses=("NEW", "INVESTIGATING", "CONTAINED"),
        severities=("HIGH", "CRITICAL"),
        since=datetime(2024, 1, 5),
        until=datetime(2024, 1, 25),
    )
    return lookup.alert_page(found, fx.users(spark, d), "risk", 100, 20).select(*ALERT_OUT, port(), "status", "assigned_to")


@register(
    q.query(
        [*q.ALERTS, q.USERS],
        f"""select {", ".join("a." + c for c in ALERT_OUT)}, coalesce(a.destination_port, -1) as port, status, u.username as assigned_to
from alerts a left join users u on u.id = a.assigned_to_id
where attack_type = 'portscan' and (source_ip = '203.0.113.5' or destination_ip = '203.0.113.5')
order by a.last_seen_at desc, a.alert_id desc limit 50""",
    )
)
def alert_page_by_last_seen(spark, d):
    found = lookup.filter_alerts(fx.alerts(spark, d), attack_type="portscan", ip="203.0.113.5")
    return lookup.alert_page(found, fx.users(spark, d)).select(*ALERT_OUT, port(), "status", "assigned_to")


@register(
    q.query(
        [q.DET, q.ASSIGNED],
        "select alert_id, count(distinct src_ip) as unique_sources from assigned group by 1",
    )
)
def alert_unique_sources(spark, d):
    return lookup.unique_sources(correlate.links(fx.assigned(spark, d)), fx.network_events(spark, d))


MOVES = "case status " + " ".join(
    f"when '{s}' then '{','.join(t for t in q.STATUSES if t in lookup.MOVES[s])}'" for s in q.STATUSES
)


@register(
    q.query(
        [*q.ALERTS, q.USERS, q.AUDIT, q.NOTES],
        f"""select a.alert_id, status, u.username as assigned_to, c.username as acknowledged_by, unique_sources,
  (select count(*) from notes n where n.alert_id = a.alert_id) as n_notes,
  (select count(*) from audit h where h.entity_type = 'alert' and h.entity_id = cast(a.alert_id as varchar)) as n_history,
  {MOVES} end as moves
from alerts a left join users u on u.id = a.assigned_to_id left join users c on c.id = a.acknowledged_by_id
join (select alert_id, count(distinct src_ip) as unique_sources from assigned group by 1) s using (alert_id)""",
    )
)
def alert_detail(spark, d):
    detail = lookup.alert_detail(
        fx.alerts(spark, d),
        correlate.links(fx.assigned(spark, d)),
        fx.network_events(spark, d),
        fx.notes(spark, d),
        fx.audit(spark, d),
        fx.users(spark, d),
    )
    return detail.select(
        "alert_id", "status", "assigned_to", "acknowledged_by", "unique_sources", "n_notes", "n_history",
        F.concat_ws(",", "allowed_moves").alias("moves"),
    )


@register(
    q.query(
        [*q.ALERTS, q.AUDIT],
        """select a.alert_id, h.id as audit_id, h.ts, h.actor, h.action from audit h
join rolled a on h.entity_type = 'alert' and h.entity_id = cast(a.alert_id as varchar)""",
    )
)
def alert_history(spark, d):
    return lookup.alert_history(fx.alerts(spark, d), fx.audit(spark, d))


@register(
    q.query(
        [q.DET, q.ASSIGNED, q.NOTES, q.USERS],
        """select n.alert_id, n.id as note_id, u.username as author, n.body, n.created_at
from notes n left join users u on u.id = n.author_id""",
    )
)
def alert_notes(spark, d):
    return lookup.alert_notes(fx.notes(spark, d), fx.users(spark, d))


@register(
    q.query(
        [q.AUDIT],
        """select id, ts, actor, action, entity_type, entity_id from audit
where action = 'alert.status_changed' and entity_type = 'alert' and ts >= timestamp '2024-01-10'
order by id desc limit 50 offset 5""",
    )
)
def audit_page(spark, d):
    found = lookup.filter_audit(
        fx.audit(spark, d), action="alert.status_changed", entity_type="alert", since=datetime(2024, 1, 10)
    )
    return lookup.newest_audit(found, 50, 5).select("id", "ts", "actor", "action", "entity_type", "entity_id")


@register(
    q.query([q.AUDIT], "select count(*) as total from audit where actor = 'u7' and ts <= timestamp '2024-01-20'")
)
def audit_total(spark, d):
    return lookup.total(lookup.filter_audit(fx.audit(spark, d), actor="u7", until=datetime(2024, 1, 20)))


@register(q.query([q.USERS], "select * from users order by id limit 20 offset 10"))
def users_page(spark, d):
    return lookup.page(fx.users(spark, d), [F.asc("id")], 20, 10)
