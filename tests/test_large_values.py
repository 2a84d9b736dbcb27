"""Queries on envelopes equal their SQL also where a value makes a confidence above one."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_queries  # noqa: E402


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("large")
    source = "/root/testdata/sf0.001/events.parquet"
    value = "case when event_id % 5 = 0 then value + 520.16 when event_id % 83 = 0 then value + 2000000 else value end"
    duckdb.sql(f"copy (select * replace ({value} as value) from '{source}') to '{path}/events.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["invalid_detections", "valid_detections", "stream_predictions", "stream_alerts", "stream_feed", "stream_audit", "stream_alert_snapshot"])
def test_query_equals_sql(spark, folder, name):
    problem, rows, _ = check_queries.compare(spark, check_queries.connect(folder), name, folder)
    assert not problem and rows
