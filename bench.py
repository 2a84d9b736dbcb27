"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs to its end into a sink that keeps nothing; a first small query warms the session up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.catalog import QUERIES  # noqa: E402
from flowloom.catalog.learning import prepared  # noqa: E402
from flowloom.plans import models  # noqa: E402
from flowloom.session import local_session  # noqa: E402

HEADLINE = [
    "attack_timeseries",
    "event_distribution",
    "stats_summary",
    "attack_statistics",
    "event_page",
    "event_alerts",
    "alert_rollup",
    "alert_sessions_late",
    "alert_escalations",
    "alert_unique_sources",
    "alert_page_by_risk",
    "alert_detail",
    "audit_page",
    "flow_features",
    "flow_clean",
    "cleaning_report",
    "temporal_split",
    "cap_per_class",
    "scaler_statistics",
    "per_class_metrics",
    "ranking_metrics",
    "source_trailing_count",
    "packet_features",
    "built_flows",
    "mutual_information",
    "failed_login_windows",
    "destination_features",
    "traffic_anomaly",
    "risk_score",
    "workflow_state",
    "invalid_detections",
    "stream_alerts",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    run(QUERIES["audit_page"](spark, folder))
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    # fit and batch scoring of the linear candidate; microseconds per flow beside the seconds
    flows, train = prepared(spark, folder)
    start = time.perf_counter()
    model = models.fit("logistic_regression", train)
    seconds["fit_logistic_regression"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    run(models.score(model, flows).select("capture_order", "pred", "proba"))
    seconds["score_flows"] = round(time.perf_counter() - start, 3)
    scored = flows.count()
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "train_rows": train.count(),
        "scored_rows": scored,
        "score_us_per_flow": round(seconds["score_flows"] / max(scored, 1) * 1e6, 2),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
