"""Windows that start at the first event after the last window: rate limits, login throttles.

The first row of a key opens a window of the key's period; the first row at or after its end opens the
next one. Every row's successor, the first row a period later, is found by one blocked scan over time;
the openers are what the first row reaches through successors, by pointer doubling: after n rounds
2**n openers of every key are known. A key may own most rows: all joins are by (key, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.scan import Measure, running
from flowloom.session import discard, stored

#: Time per block of the scans, in microseconds.
BLOCK_US = 3_600_000_000


def _successors(instants: DataFrame, keys: list[str], block_us: int) -> DataFrame:
    """keys, at, next: the first instant at or after at + period, where there is one."""
    probe = lambda at, kind: F.struct(at.alias("t"), F.lit(kind).alias("probe"), F.col("at"))
    axis = instants.select(*keys, F.inline(F.array(probe(F.col("at"), 0), probe(F.col("at") + F.col("period"), 1))))
    axis = axis.withColumn("_block", -F.floor(F.col("t") / block_us))
    later = Measure("min", F.when(F.col("probe") == 0, F.col("t")))
    found = running(axis, keys, "_block", [F.desc("t"), "probe"], {"next": later})
    return found.where((F.col("probe") == 1) & F.col("next").isNotNull()).select(*keys, "at", "next")


def window_starts(instants: DataFrame, keys: list[str], block_us: int = BLOCK_US) -> DataFrame:
    """keys, at: the openers among distinct `instants` (keys, at, period)."""
    jump = stored(_successors(instants, keys, block_us), "successors")
    starts = stored(instants.groupBy(*keys).agg(F.min("at").alias("at")), "window-starts")
    while True:
        reached = stored(starts.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at")), "window-starts")
        if reached.isEmpty():
            discard(jump, reached)
            return starts
        onward = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("further"))
        doubled = stored(jump.join(onward, [*keys, "next"]).select(*keys, "at", F.col("further").alias("next")), "successors")
        more = stored(starts.unionByName(reached), "window-starts")
        discard(jump, starts, reached)
        jump, starts = doubled, more


def greedy_windows(rows: DataFrame, keys: list[str], us: Column, period: Column, block_us: int = BLOCK_US) -> DataFrame:
    """`rows` with `window_us`, the time of the row that opened their window.

    `us` is a row's time in microseconds, `period` the length of its key's windows in microseconds. Keys
    must not be null. Rows of the same time share a window.
    """
    timed = rows.withColumns({"_us": us, "_period": period})
    instants = timed.select(*keys, F.col("_us").alias("at"), F.col("_period").alias("period")).distinct()
    starts = window_starts(instants, keys, block_us).select(*keys, F.col("at").alias("_us"), F.lit(True).alias("_opens"))
    opened = instants.select(*keys, F.col("at").alias("_us")).join(starts, [*keys, "_us"], "left")
    opened = opened.withColumn("_block", F.floor(F.col("_us") / block_us))
    latest = Measure("max", F.when(F.col("_opens"), F.col("_us")))
    windows = running(opened, keys, "_block", ["_us"], {"window_us": latest}).select(*keys, "_us", "window_us")
    return timed.join(windows, [*keys, "_us"]).select(*rows.columns, "window_us")
