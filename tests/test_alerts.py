"""Alert correlation, batch and streaming, on hand-made detections."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowloom import session
from flowloom.functions import alerts as texts
from flowloom.operators import correlate, workflow
from flowloom.registry import MOVES, STATUSES
from flowloom.sources import audit
from flowloom.sources import detections as contract
from flowloom.sources import settings
from flowloom.streaming import alerts, ingest, snapshot

START = datetime(2026, 1, 5, 12, 0)
BASE = {
    "src_ip": "192.0.2.44", "dst_ip": "203.0.113.10", "src_port": 51515, "dst_port": 80, "protocol": "tcp",
    "packet_count": 1234, "byte_count": 98765, "duration": 2.5, "packets_per_sec": 493.6,
    "bytes_per_sec": 39506.0, "features": {"ack_share": 0.25}, "source": "sim", "label": "ddos",
    "confidence": 0.97, "class_probs": {"ddos": 0.97, "dos": 0.03},
    "explanation": [{"feature": "bytes_per_sec", "value": None, "contribution": 0.5, "weight": 41.0}],
    "risk_score": 85, "risk_components": {"traffic_anomaly": 12.0}, "model_version": "model-under-test",
}


def detection(seconds=0.0, **changes):
    moment = (START + timedelta(seconds=seconds)).isoformat() + "+00:00"
    return BASE | {"ts": moment} | changes


def envelopes(spark, items, first=0):
    rows = [(first + i, f"{first + i}-0", json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(items)]
    return spark.createDataFrame(rows, contract.ENVELOPE)


def parsed(spark, items):
    return contract.valid(contract.check(envelopes(spark, items)))


def rolled(spark, items, **options):
    return correlate.rollup(correlate.assign_alerts(parsed(spark, items), **options))


def test_one_alert(spark):
    a = rolled(spark, [detection()]).first()
    assert (a.severity, a.detection_count, a.risk_score) == ("CRITICAL", 1, 85)
    assert a.description == "DDoS detected — confidence 97.0% — target 203.0.113.10:80"
    assert a.recommended_action.startswith("Escalate to the on-call responder now. Confirm service health on 203.0.113.10")


def test_gate(spark):
    low = [detection(label="benign", risk_score=0), detection(risk_score=20)]
    assert rolled(spark, low).count() == 0
    assert rolled(spark, [detection()], min_risk=90).count() == 0


FLOOD = [
    detection(0, risk_score=45, src_ip="198.51.100.1"),
    detection(5, risk_score=70, src_ip="198.51.100.2"),
    detection(10, risk_score=92, src_ip="198.51.100.3", packets_per_sec=90000.0),
]


def test_aggregation_and_escalation(spark):
    found = rolled(spark, FLOOD)
    a = found.first()
    assert found.count() == 1
    assert (a.detection_count, a.risk_score, a.source_ip, a.peak_packets_per_sec) == (3, 92, "198.51.100.3", 90000.0)
    lifted = correlate.escalations(found).orderBy("event_id").collect()
    assert [(r.before_severity, r.after_severity) for r in lifted] == [("MEDIUM", "HIGH"), ("HIGH", "CRITICAL")]
    audit = correlate.system_audit(found, correlate.escalations(found))
    assert sorted(r.action for r in audit.collect()) == ["alert.created", "alert.escalated", "alert.escalated"]


def test_a_band_already_passed_is_no_escalation(spark):
    items = [detection(0, risk_score=70), detection(1, risk_score=50), detection(2, risk_score=75), detection(3, risk_score=81)]
    lifted = correlate.escalations(rolled(spark, items)).collect()
    assert [(r.event_id, r.before_severity, r.after_severity) for r in lifted] == [(3, "HIGH", "CRITICAL")]


SEPARATE = [
    detection(),
    detection(1, dst_ip="203.0.113.11"),
    detection(2, label="portscan"),
    detection(1200),
]


def test_separation(spark):
    assert rolled(spark, SEPARATE).count() == 4
    assert rolled(spark, [detection(), detection(900)]).count() == 1  # a gap equal to the window
    assert rolled(spark, [detection(), detection(900.000001)]).count() == 2


@pytest.mark.parametrize(
    "share,text",
    [(0.9725, "97.2%"), (0.5065, "50.6%"), (1.0, "100.0%"), (0.015, "1.5%"), (0.99999, "100.0%"), (0.5075, "50.7%")],
)
def test_percent(spark, share, text):
    assert f"{share:.1%}" == text
    assert spark.range(1).select(texts.percent(F.lit(share))).first()[0] == text


def test_titles(spark):
    rows = spark.createDataFrame([("web_attack",), ("dos",), ("x",)], "l string").select(texts.title(F.col("l")))
    assert [r[0] for r in rows.collect()] == ["Web attack", "DoS", "X"]


BAD = {
    "label": detection(label="DDoS"),
    "risk_score": detection(risk_score=150),
    "confidence": detection(confidence=1.2),
    "ts": detection() | {"ts": "2026-01-05T12:00:00"},
    "src_ip": detection(src_ip="300.1.1.1"),
    "dst_port": detection(dst_port=70000),
    "protocol": detection(protocol="sctp"),
    "packet_count": detection(packet_count=-1),
    "duration": detection(duration=float("inf")),
    "features": detection(features={f"f{i}": 1.0 for i in range(201)}),
    "class_probs": detection(class_probs={"Bad Key": 0.5}),
    "explanation": detection(explanation=[BASE["explanation"][0] | {"weight": 101.0}]),
    "model_version": detection(model_version=""),
    "unknown field": detection(extra=1),
    "unreadable": '{"ts": "2026',
}


def test_contract_names_what_is_wrong(spark):
    checked = contract.check(envelopes(spark, list(BAD.values())))
    got = [r.errors for r in checked.orderBy("seq").collect()]
    assert got == [[name] for name in BAD]
    nested = detection(explanation=[BASE["explanation"][0] | {"more": 1}])
    assert contract.check(envelopes(spark, [nested])).first().errors == ["unknown field"]


def test_contract_defaults(spark):
    short = {k: v for k, v in detection().items() if k not in contract.OPTIONAL}
    row = parsed(spark, [short | {"src_ip": "2001:DB8::0:1"}]).first()
    assert (row.src_port, row.features, row.explanation, row.src_ip) == (None, {}, [], "2001:db8::1")


def config(**changes):
    weights = {"ml_confidence": 0.4, "traffic_anomaly": 0.25, "attack_severity": 0.25, "source_reputation": 0.1}
    return json.dumps({"alert_min_risk": 31, "aggregation_window_minutes": 15, "risk_weights": weights} | changes)


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert settings.read_config(spark, path) == settings.Config()
    first = settings.replace_config(spark, path, config(alert_min_risk=90), 7).first()
    assert first.before is None
    second = settings.replace_config(spark, path, config(alert_min_risk=40), 7).first()
    assert json.loads(second.before)["alert_min_risk"] == 90
    assert settings.read_config(spark, path).min_risk == 40
    for wrong in (
        config(alert_min_risk=101),
        config(aggregation_window_minutes=0),
        config(risk_weights={"ml_confidence": 0.9}),
        config(extra=1),
        "no json",
    ):
        with pytest.raises(ValueError):
            settings.replace_config(spark, path, wrong)


def test_stored_settings_that_break_the_contract_are_refused(spark, tmp_path):
    path = str(tmp_path / "settings")
    row = spark.createDataFrame([(1, config(alert_min_risk=101), 7)], "version long, value string, updated_by long")
    row.withColumn("updated_at", F.current_timestamp()).write.parquet(path)
    with pytest.raises(ValueError, match="invalid stored settings"):
        settings.read_config(spark, path)


def test_arrival_numbers_are_unique_over_partitions(spark):
    records = spark.createDataFrame([(p, o, bytearray(b"{}")) for p in range(3) for o in range(4)], "partition int, offset long, value binary")
    rows = ingest.partitioned_envelopes(records).collect()
    assert len({r.seq for r in rows}) == len({r.stream_id for r in rows}) == 12 and {r.data for r in rows} == {"{}"}
    assert records.count() == 12 and ingest.partitioned_envelopes(records).columns == ["seq", "stream_id", "data"]


def test_bounded_dedupe(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "a", "x", START), (2, "a", "x", START + timedelta(hours=1)), (3, "b", "x", START)]
    schema = f"{contract.ENVELOPE}, received timestamp"
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream_rows = spark.readStream.schema(schema).parquet(path)
    out = ingest.unique_envelopes(stream_rows, "received", "2 hours")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.stream_id for r in found.collect()) == ["a", "b"] and found.columns == ["seq", "stream_id", "data"]


def stream(spark, out, groups, actions=None, checkpoint=lambda i: "c2"):
    """Feed groups of envelopes one after the other through both jobs; returns alerts and changes. An
    action of group i comes at second i, from user 100 + i."""
    done = 0
    for i, items in enumerate(groups):
        envelopes(spark, items, done).coalesce(1).write.mode("append").json(f"{out}/in")
        done += len(items)
        ingest.start_ingest(ingest.read_envelopes(spark, f"{out}/in"), out, f"{out}/c1").awaitTermination()
        for n, action in enumerate((actions or {}).get(i, [])):
            row = ("ddos", "203.0.113.10", *action, i, 1_000_000 + n, i * 1_000_000, 100 + i)
            spark.createDataFrame([row], alerts.ACTIONS).coalesce(1).write.mode("append").json(f"{out}/acts")
        acts = None
        if actions:
            acts = spark.readStream.schema(alerts.ACTIONS).json(f"{out}/acts")
        alerts.start_alerts(spark, out, f"{out}/{checkpoint(i)}", acts).awaitTermination()
    changes = spark.read.parquet(f"{out}/changes")
    return alerts.latest_alerts(changes), changes


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    out = str(tmp_path / "s")
    late = [detection(600, risk_score=50), detection(-2000, risk_score=95), detection(1400), detection(2500, label="portscan")]
    good = FLOOD + SEPARATE + late
    broken = json.dumps({"label": "ddos"})
    groups = [[*FLOOD[:2], broken], [FLOOD[2], *SEPARATE], late]
    found, changes = stream(spark, out, groups)
    numbered = [d for g in groups for d in g]
    want = correlate.rollup(correlate.assign_alerts(parsed(spark, numbered)))
    same = ["alert_id", "attack_type", "source_ip", "destination_ip", "destination_port", "first_seen_at",
            "last_seen_at", "detection_count", "risk_score", "severity", "description", "recommended_action"]
    assert sorted(found.select(same).collect()) == sorted(want.select(same).collect())
    assert spark.read.parquet(f"{out}/events").count() == len(good)
    assert [r.stream_id for r in spark.read.parquet(f"{out}/dead_letters").collect()] == ["2-0"]
    lifted = alerts.escalations(changes).select("alert_id", "event_id", "before_severity", "after_severity")
    wanted = correlate.escalations(want).select(lifted.columns)
    assert sorted(lifted.collect()) == sorted(wanted.collect())
    members = spark.read.parquet(f"{out}/members")
    links = correlate.links(correlate.assign_alerts(parsed(spark, numbered)))
    assert sorted(alerts.links(members, changes).collect()) == sorted(links.collect())


def test_closed_alerts_do_not_absorb_and_reopened_ones_do(spark, tmp_path):
    groups = [[detection(0)], [detection(5)], [detection(10)], [detection(15)]]
    actions = {0: [(0, "INVESTIGATING")], 1: [(0, "RESOLVED")], 2: [(2, "FALSE_POSITIVE"), (0, "INVESTIGATING")]}
    found, _ = stream(spark, str(tmp_path / "s"), groups, actions)
    got = {r.alert_id: (r.detection_count, r.status) for r in found.collect()}
    assert got == {0: (3, "INVESTIGATING"), 2: (1, "FALSE_POSITIVE")}


def test_stamps_and_audit_documents(spark, tmp_path):
    out = str(tmp_path / "s")
    groups = [[detection(0)], [detection(5)], [detection(6)], [detection(7)]]
    actions = {0: [(0, "INVESTIGATING")], 1: [(0, "CONTAINED")], 2: [(0, "RESOLVED")]}
    found, _ = stream(spark, out, groups[:3], actions)
    second = lambda n: datetime(1970, 1, 1, 0, 0, n)
    alert = found.filter("alert_id = 0").first()
    assert (alert.acknowledged_at, alert.acknowledged_by_id, alert.resolved_at) == (second(0), 100, second(2))
    rows = spark.read.parquet(f"{out}/audit").orderBy("ts", "action").collect()
    moved = [(r.actor_id, r.entity_type, r.entity_id, json.loads(r.before), json.loads(r.after)) for r in rows if r.action == "alert.status"]
    names = ["NEW", "INVESTIGATING", "CONTAINED", "RESOLVED"]
    assert moved == [(100 + i, "alert", "0", {"status": names[i]}, {"status": names[i + 1]}) for i in range(3)]
    created = [r for r in rows if r.action == "alert.created"]
    assert created and all(r.before is None and r.actor == "system" and json.loads(r.after)["status"] == "NEW" for r in created)


def test_a_new_checkpoint_goes_on_from_stored_alerts(spark, tmp_path):
    items = [*FLOOD, *SEPARATE, detection(600, risk_score=50), detection(1400), detection(1500, label="portscan"), detection(2500)]
    groups = [items[:3], items[3:7], items[7:9], items[9:]]
    actions = {0: [(0, "INVESTIGATING")], 1: [(0, "RESOLVED")], 3: [(0, "INVESTIGATING")]}
    whole, whole_changes = stream(spark, str(tmp_path / "a"), groups, actions)
    broken, broken_changes = stream(spark, str(tmp_path / "b"), groups, actions, lambda i: f"c2-{i // 2}")
    assert sorted(whole.collect(), key=str) == sorted(broken.collect(), key=str) and whole.count() > 3
    facts = ["alert_id", "run_id", "batch_id", "seq", "version", "type", "status", "detections"]
    assert sorted(whole_changes.select(facts).collect(), key=str) == sorted(broken_changes.select(facts).collect(), key=str)
    snapshot = alerts.read_snapshot(spark, str(tmp_path / "b"))
    assert sorted(snapshot.collect(), key=str) == sorted(broken.collect(), key=str)


def test_snapshot_rewrites_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ids, version: spark.createDataFrame([(i, version, f"{i}.{version}") for i in ids], "id long, version long, text string")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    read = lambda: {r.id: r.text for r in snapshot.read(spark, path).collect()}
    snapshot.update(rows(range(200), 1), path, 0, "id", "version")
    before = files()
    snapshot.update(rows([7], 2), path, 1, "id", "version")
    assert read() == {i: f"{i}.1" for i in range(200)} | {7: "7.2"}
    assert len(files()) == len(before) + 1 and all(files()[f] == t for f, t in before.items())
    snapshot.update(rows([7], 2), path, 1, "id", "version")  # a retry
    snapshot.update(rows([7], 1), path, 2, "id", "version")  # an older row that comes late
    snapshot.update(rows([], 9), path, 3, "id", "version")
    snapshot.update(rows([7, 500], 3), path, 4, "id", "version")
    assert read() == {i: f"{i}.1" for i in range(200)} | {7: "7.3", 500: "500.3"}
    # a batch that broke off before its index is not seen, and its retry replaces it
    rows([1], 8).write.parquet(f"{path}/rows/number=5/bucket=3")
    assert read()[1] == "1.1"
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, str(tmp_path / "none"))


def test_runs_that_show_up_late_are_not_lost(spark, tmp_path):
    """Two runs of one key in one batch of the first job, the earlier one's file seen second, and then
    the whole batch once more, as a retry writes it."""
    out = str(tmp_path / "s")
    rows = ingest.summarise(ingest.runs(parsed(spark, [detection(0), detection(2000)]), 15, 31), 15)
    rows = rows.withColumn("batch_id", F.lit(0).cast("long"))
    early, late = (rows.filter(F.col("run_id") == i).coalesce(1) for i in (0, 1))
    for part in (late, early, rows):
        part.write.mode("append").parquet(f"{out}/runs")
        alerts.start_alerts(spark, out, f"{out}/c").awaitTermination()
    changes = spark.read.parquet(f"{out}/changes")
    assert sorted(r.run_id for r in changes.collect()) == [0, 1]
    assert alerts.latest_alerts(changes).agg(F.sum("detection_count")).first()[0] == 2


def test_refused_actions_and_audit_rows_are_stored(spark, tmp_path):
    groups = [[detection(0, risk_score=45)], [detection(5, risk_score=85)], [detection(10)]]
    actions = {0: [(0, "RESOLVED"), (77, "INVESTIGATING")], 1: [(0, "INVESTIGATING"), (0, "NEW")]}
    found, changes = stream(spark, str(tmp_path / "s"), groups, actions)
    got = {r.alert_id: (r.detection_count, r.status) for r in found.collect()}
    assert got == {0: (3, "INVESTIGATING")}
    assert sorted((r.alert_id, r.known) for r in alerts.refused(changes).collect()) == [(0, True), (0, True), (77, False)]
    audit = sorted((r.alert_id, r.action) for r in alerts.audit_rows(changes).collect())
    assert audit == [(0, "alert.created"), (0, "alert.escalated"), (0, "alert.status")]


def acts(spark, rows):
    moments = [(i, a, kind, status, 1, START + timedelta(seconds=i)) for i, (a, kind, status) in enumerate(rows)]
    return spark.createDataFrame(
        moments, "seq long, alert_id long, action string, status string, user_id long, ts timestamp"
    )


@pytest.mark.parametrize("bits, levels", [(1, 1), (1, 3), (2, 2), (12, 3)])
def test_workflow(spark, bits, levels):
    steps = [
        (1, "acknowledge", "INVESTIGATING"),
        (1, "status", "CONTAINED"),
        (1, "status", "RESOLVED"),
        (2, "status", "RESOLVED"),
        (1, "acknowledge", "INVESTIGATING"),
        (2, "acknowledge", "INVESTIGATING"),
        (2, "acknowledge", "INVESTIGATING"),
        (3, "status", "FALSE_POSITIVE"),
        (1, "status", "INVESTIGATING"),
    ]
    done = workflow.replay(acts(spark, steps), bits, levels)
    assert [r.applied for r in done.orderBy("seq").collect()] == [True, True, True, False, False, True, False, True, True]
    state = {r.alert_id: r for r in workflow.current_state(done).collect()}
    assert (state[1].status, state[1].resolved_at, state[1].applied) == ("INVESTIGATING", None, 4)
    assert state[1].acknowledged_at == START
    assert state[3].resolved_at == START + timedelta(seconds=7)
    assert workflow.audit_rows(done).count() == 6 and workflow.refused(done).count() == 3


def test_replay_equals_a_walk(spark):
    rng = random.Random(3)
    kinds = [("acknowledge", "INVESTIGATING")] + [("status", s) for s in (*STATUSES, "NOWHERE", None)]
    steps = [(rng.choice([1, 1, 1, 2, 3]), *rng.choice(kinds)) for _ in range(600)]
    want, now = [], {}
    for alert, kind, status in steps:
        before = now.get(alert, "NEW")
        allowed = status in MOVES[before] and not (kind == "acknowledge" and before != "NEW")
        now[alert] = status if allowed else before
        want.append((before, now[alert], allowed))
    for bits, levels in ((2, 4), (4, 2), (12, 3)):
        done = workflow.replay(acts(spark, steps), bits, levels).orderBy("seq").collect()
        assert [(r.before, r.after, r.applied) for r in done] == want
    assert workflow.replay(acts(spark, steps).limit(0)).count() == 0


def test_assignee(spark):
    users = spark.createDataFrame(
        [(1, "ann", "analyst", True), (2, "vic", "viewer", True), (3, "old", "admin", False)],
        "id long, username string, role string, is_active boolean",
    )
    asked = spark.createDataFrame([(1, 9, 1), (2, 9, 2), (3, 9, 3), (4, 8, 1), (5, 8, None)], "seq long, alert_id long, user_id long")
    done = workflow.assignments(asked, users)
    assert [r.accepted for r in done.orderBy("seq").collect()] == [True, False, False, True, True]
    assert {r.alert_id: r.assigned_to_id for r in workflow.current_assignee(done).collect()} == {9: 1, 8: None}


def test_audit_rows_are_appended_by_day(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame(
        [(START, 1, "a" * 70, "2001:DB8::0:1"), (START + timedelta(days=1), None, None, "no address")],
        "ts timestamp, actor_id long, actor string, ip string",
    )
    rows = rows.withColumns({"action": F.lit("x"), "after": audit.document(status=F.lit("NEW"), note=F.lit(True))})
    audit.append_audit(rows, path)
    audit.append_audit(rows.limit(1), path)
    found = spark.read.parquet(path).orderBy("ts").collect()
    assert [(r.day.day, len(r.actor), r.ip, r.entity_id) for r in found] == [(5, 64, "2001:db8::1", None)] * 2 + [(6, 6, None, None)]
    assert found[2].actor == "system" and json.loads(found[0].after) == {"status": "NEW", "note": True}


def test_notes(spark):
    rows = spark.createDataFrame([(1, 5, 2, " hi "), (2, 5, 2, "   "), (3, 5, 2, "x" * 5001)], "id long, alert_id long, author_id long, body string")
    assert [r.body for r in workflow.add_notes(rows).collect()] == ["hi"]


def test_state_lies_in_no_more_partitions_than_the_cores_can_use(spark, tmp_path, monkeypatch):
    out, given, dealt = str(tmp_path), spark.conf.get(session.PARTITIONS), []
    monkeypatch.setattr(session, "STATE_PARTITIONS", 1)
    summarise = ingest.summarise

    def noted(members, minutes):
        dealt.append(members.sparkSession.conf.get(session.PARTITIONS))
        return summarise(members, minutes)

    monkeypatch.setattr(ingest, "summarise", noted)
    items = [detection(i, dst_ip=f"203.0.113.{i}") for i in range(3)]
    with session.shuffled(spark, 12):
        stream(spark, out, [items, items])
        assert spark.conf.get(session.PARTITIONS) == "12"
    assert spark.conf.get(session.PARTITIONS) == given
    assert dealt == ["12", "12"]  # the work on a micro-batch is dealt out as before
    for checkpoint in ("c1", "c2"):
        parts = [p.name for p in (tmp_path / checkpoint / "state" / "0").iterdir() if p.name.isdigit()]
        assert len(parts) == spark.sparkContext.defaultParallelism
