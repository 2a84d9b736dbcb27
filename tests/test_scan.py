"""Blocked scans against plain windows and brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.operators import correlate, packets, scan
from flowloom.operators.scan import Measure, id_block, running, smallest_by_hash


@pytest.fixture(scope="module")
def table(spark):
    random.seed(5)
    # one key holds most rows; ids have large holes
    rows = [(random.choice("aaaaabc"), i * i * 37 + i, random.randint(-50, 50)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, id long, v int").repartition(5)


@pytest.mark.parametrize("levels,bits", [(1, 3), (1, 12), (2, 3), (2, 2)])
def test_running_equals_window(table, levels, bits):
    measures = {
        "s": Measure("sum", F.col("v")),
        "before": Measure("sum", F.col("v"), inclusive=False),
        "top": Measure("max", F.col("v")),
        "low": Measure("min", F.col("v"), inclusive=False),
    }
    got = running(table.withColumn("b", id_block(F.col("id"), bits)), ["k"], "b", ["id"], measures, levels)
    w = Window.partitionBy("k").orderBy("id")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = table.select(
        "k", "id",
        F.sum("v").over(upto).alias("s"), F.coalesce(F.sum("v").over(prior), F.lit(0)).alias("before"),
        F.max("v").over(upto).alias("top"), F.min("v").over(prior).alias("low"),
    )
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 600


def test_smallest_by_hash_is_exact_and_repeatable(table):
    got = smallest_by_hash(table, ["k"], F.col("id"), 9, F.lit(40))
    w = Window.partitionBy("k").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("|9"))))
    want = table.withColumn("r", F.row_number().over(w)).filter("r <= 40").drop("r")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    again = smallest_by_hash(table.repartition(3), ["k"], F.col("id"), 9, F.lit(40))
    assert again.exceptAll(got).isEmpty()


def fold(rows, gap):
    """The lookup as written down: newest alert of the key seen within the gap, else a new one."""
    alerts, out = {}, {}
    for key, seq, ts in sorted(rows, key=lambda r: r[1]):
        known = [a for a in alerts.setdefault(key, []) if a[1] >= ts - gap]
        alert = max(known, key=lambda a: a[1]) if known else None
        if alert is None:
            alert = [seq, ts]
            alerts[key].append(alert)
        alert[1] = max(alert[1], ts)
        out[seq] = alert[0]
    return out


@pytest.mark.parametrize("levels,bits", [(1, 4), (2, 4), (1, 12), (3, 1)])
def test_sessions_with_late_rows_equal_a_literal_fold(spark, monkeypatch, levels, bits):
    random.seed(3)
    rows = [(random.choice("xxy"), i * 3, i * 40 + random.randint(-900, 300)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(scan, "BLOCK_BITS", 3)
    got = correlate.sessions(df, ["k"], 200, ["id"], levels=levels, block_bits=bits).select("id", "opener.id").collect()
    assert {r[0]: r[1] for r in got} == fold(rows, 200)


def test_trailing_count_with_ties(spark):
    random.seed(8)
    times = sorted(random.choice([i * 1.0, i * 1.0, i + 0.5]) for i in range(300))
    rows = [(i, random.choice(["h", "h", "o"]), t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, src string, t double").withColumn(
        "ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))
    )
    got = {r.event_id: r["count"] for r in packets.trailing_count(df).collect()}
    want = {i: sum(1 for j, s, u in rows if s == src and j <= i and t - 2 <= u <= t) for i, src, t in rows}
    assert got == want
