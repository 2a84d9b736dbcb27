"""Plan shapes that matter at scale, and IP text against the standard library."""

import ipaddress
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from flowloom.catalog import QUERIES
from flowloom.functions.net import canonical_ip, subnet24
from flowloom.operators import lookup
from flowloom.plans import dashboard

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_detections_are_cut_into_blocks(spark):
    for name in ("alert_sessions", "alert_rollup", "source_reputation"):
        specs = re.findall(r"windowspecdefinition\(([^()]*)", plan(QUERIES[name](spark, FOLDER)))
        assert specs and all("_block" in s for s in specs), name


def test_escalations_need_no_window_of_their_own(spark):
    windows = lambda name: plan(QUERIES[name](spark, FOLDER)).count("windowspecdefinition")
    assert windows("alert_escalations") == windows("alert_rollup")


def test_time_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["event_distribution"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts" in text
    assert "user_id" not in re.findall(r"ReadSchema: (\S+)", text)[0]


def test_pages_do_not_sort_everything(spark):
    for name in ("event_page", "audit_page", "alert_page_by_risk"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, FOLDER))


def test_replay_has_no_python(spark):
    text = plan(QUERIES["workflow_replay"](spark, FOLDER))
    assert "Pandas" not in text and "Python" not in text and "Arrow" not in text


def test_no_cross_joins(spark):
    for name in ("stats_summary", "cleaning_report", "overall_metrics", "class_weights", "risk_score", "alert_detail"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def standard(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    if found.version == 6 and found.ipv4_mapped:
        return f"::ffff:{int(found) >> 16 & 0xFFFF:x}:{int(found) & 0xFFFF:x}"
    return str(found)


def test_canonical_ip(spark):
    random.seed(1)
    texts = [
        "1.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "FE80:0:0:0:0:0:0:1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
        "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1::2::3", "1:::2", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
        "12345::", "g::", "", "01.2.3.4", "0:0:1:0:0:0:1:0", "1:0:0:2:0:0:0:3", "a:b:c:d:e:f:1.2.3.4",
    ]
    for _ in range(200):
        texts.append(":".join(random.choice(["0", "0", "0000", "1", "ab", "0f00"]) for _ in range(8)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", canonical_ip(F.col("t")).alias("got")).collect():
        assert r.got == standard(r.t), r.t


def test_subnet(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("2001:db8::1",)], "t string")
    assert [r[0] for r in rows.select(subnet24(F.col("t"))).collect()] == ["10.1.2", "2001:db8::1"]


def test_stored_days_are_pruned_and_dropped(spark, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 21600 + 1767225600).alias("ts"),  # four a day from 2026-01-01
        F.when(F.col("id") % 3 == 0, "ddos").otherwise("benign").alias("label"),
        F.lit(50).alias("risk_score"),
    )
    dated = rows.withColumn("day", F.to_date("ts"))
    for name in ("events", "predictions"):
        dated.write.partitionBy("day").parquet(f"{tmp_path}/{name}")
    events, predictions = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("events", "predictions"))
    as_of = datetime(2026, 1, 10, 18)
    found = dashboard.distribution(events, predictions, "24h", as_of)
    assert plan(found).count("PartitionFilters: [isnotnull(day") == 2
    assert sum(r.events for r in found.collect()) == 5
    series = dashboard.timeseries(events, predictions, "24h", "1h", as_of)
    assert plan(series).count("PartitionFilters: [isnotnull(day") == 2
    assert sum(r.events for r in series.collect()) == 5
    page = lookup.filter_events(predictions, since=datetime(2026, 1, 9), until=datetime(2026, 1, 9, 12))
    assert "PartitionFilters: [isnotnull(day" in plan(page) and page.count() == 3
    dropped = dashboard.drop_expired_days(spark, f"{tmp_path}/events", 7, as_of)
    assert dropped == ["2026-01-01", "2026-01-02"]
    assert spark.read.parquet(f"{tmp_path}/events").count() == 32
