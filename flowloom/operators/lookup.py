"""Filtered pages, point lookups and the joins behind detail views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.flows import lookup
from flowloom.plans.dashboard import between, typed
from flowloom.registry import MOVES, STATUSES

MAX_PAGE = 200


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Top rows by `order`: each task keeps limit + offset rows, no full sort."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def one(df: DataFrame, column: str, value) -> DataFrame:
    """The row with that id; none is an error."""
    found = df.filter(F.col(column) == value)
    if found.isEmpty():
        raise LookupError(f"{column} {value} not found")
    return found


def filter_events(
    rows: DataFrame,
    label: str | None = None,
    ip: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    min_risk: int | None = None,
) -> DataFrame:
    """`rows` are events joined with predictions; a filter left out is not in the plan."""
    if label is not None:
        rows = rows.filter(F.col("label") == label)
    if ip is not None:
        rows = rows.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    rows = between(rows, "ts", since, until)
    if min_risk is not None:
        rows = rows.filter(F.col("risk_score") >= min_risk)
    return rows


def newest_events(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(rows, [F.desc("ts"), F.desc("event_id")], limit, offset)


def events_of_alert(rows: DataFrame, links: DataFrame, alert_id: int) -> DataFrame:
    return rows.join(links.filter(F.col("alert_id") == alert_id), "event_id")


def event_alerts(events: DataFrame, links: DataFrame) -> DataFrame:
    """Each event with its alerts: a row per link, one row with null where there is none.

    Rows instead of a list per event, so no group is ever held whole in memory.
    """
    return events.select("event_id", "ts").join(links, "event_id", "left")


def unique_sources(links: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct sources per alert: duplicates fall away per task before the shuffle on the alert."""
    rows = links.join(events.select("event_id", "src_ip"), "event_id")
    return rows.groupBy("alert_id").agg(F.count_distinct("src_ip").alias("unique_sources"))


def filter_alerts(
    alerts: DataFrame,
    statuses: tuple[str, ...] = (),
    severities: tuple[str, ...] = (),
    attack_type: str | None = None,
    ip: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Alerts whose first to last seen interval meets [since, until], and the other conditions."""
    if statuses:
        alerts = alerts.filter(F.col("status").isin(*statuses))
    if severities:
        alerts = alerts.filter(F.col("severity").isin(*severities))
    if attack_type is not None:
        alerts = alerts.filter(F.col("attack_type") == attack_type)
    if ip is not None:
        alerts = alerts.filter((F.col("source_ip") == ip) | (F.col("destination_ip") == ip))
    if since is not None:
        alerts = alerts.filter(F.col("last_seen_at") >= typed(alerts, "last_seen_at", since))
    if until is not None:
        alerts = alerts.filter(F.col("first_seen_at") <= typed(alerts, "first_seen_at", until))
    return alerts


def user_names(users: DataFrame, id_column: str, name: str) -> DataFrame:
    return users.select(F.col("id").alias(id_column), F.col("username").alias(name))


def alert_page(
    alerts: DataFrame, users: DataFrame, sort: str = "last_seen", limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of alerts with assignee names; only the page, at most 200 rows, meets the users."""
    if sort not in ("last_seen", "risk"):
        raise ValueError("sort must be last_seen or risk")
    order = [F.desc("last_seen_at"), F.desc("alert_id")]
    if sort == "risk":
        order = [F.desc("risk_score"), *order]
    rows = page(alerts, order, limit, offset)
    return rows.join(user_names(users, "assigned_to_id", "assigned_to"), "assigned_to_id", "left").orderBy(*order)


def filter_audit(
    audit: DataFrame,
    actor: str | None = None,
    action: str | None = None,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    equal = {"actor": actor, "action": action, "entity_type": entity_type, "entity_id": entity_id}
    for column, value in equal.items():
        if value is not None:
            audit = audit.filter(F.col(column) == value)
    return between(audit, "ts", since, until)


def newest_audit(audit: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(audit, [F.desc("id")], limit, offset)


def allowed_moves(status: Column) -> Column:
    """Statuses that may follow, in status order."""
    table = {s: ",".join(t for t in STATUSES if t in MOVES[s]) for s in STATUSES}
    return F.split(lookup(status, table), ",")


def alert_history(alerts: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit rows of alerts, a row each, to be read in (alert, audit id) order."""
    ids = alerts.select("alert_id", F.col("alert_id").cast("string").alias("entity_id"))
    rows = audit.filter(F.col("entity_type") == "alert")
    return rows.join(ids, "entity_id").select("alert_id", F.col("id").alias("audit_id"), "ts", "actor", "action")


def alert_notes(notes: DataFrame, users: DataFrame) -> DataFrame:
    """Notes with author names, a row each, to be read in (alert, created, note id) order."""
    named = notes.join(user_names(users, "author_id", "author"), "author_id", "left")
    return named.select("alert_id", F.col("id").alias("note_id"), "author", "body", "created_at")


def alert_detail(
    alerts: DataFrame,
    links: DataFrame,
    events: DataFrame,
    notes: DataFrame,
    audit: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """The scalar part of every alert's detail view.

    Notes and history are counted here and served as rows by `alert_notes` and `alert_history`: one
    busy alert may own most of them, so they are not packed into its row.
    """
    counted_notes = notes.groupBy("alert_id").agg(F.count("*").alias("n_notes"))
    counted_history = alert_history(alerts, audit).groupBy("alert_id").agg(F.count("*").alias("n_history"))
    zero = F.lit(0).cast("long")
    return (
        alerts.join(unique_sources(links, events), "alert_id", "left")
        .join(counted_notes, "alert_id", "left")
        .join(counted_history, "alert_id", "left")
        .join(user_names(users, "assigned_to_id", "assigned_to"), "assigned_to_id", "left")
        .join(user_names(users, "acknowledged_by_id", "acknowledged_by"), "acknowledged_by_id", "left")
        .withColumn("allowed_moves", allowed_moves(F.col("status")))
        .withColumns({c: F.coalesce(c, zero) for c in ["unique_sources", "n_notes", "n_history"]})
    )
