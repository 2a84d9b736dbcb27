"""Failed logins per user and address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.correlate import micros
from flowloom.operators.spacing import greedy_windows
from flowloom.registry import LOGIN_LIMITS, LOGIN_WINDOW_MINUTES


def failed_logins(
    audit: DataFrame, minutes: int = LOGIN_WINDOW_MINUTES, limits: dict[str, int] = LOGIN_LIMITS
) -> DataFrame:
    """Failures per window, scope (user or ip) and key, with whether the limit is reached.

    A window starts at the first failure after the one before has ended. Failures without an address
    count for the address "unknown", those without a user for no user.
    """
    failed = audit.filter(F.col("action") == "auth.login_failed")
    scopes = F.array(
        F.struct(F.lit("user").alias("scope"), F.col("actor").alias("key")),
        F.struct(F.lit("ip").alias("scope"), F.coalesce("ip", F.lit("unknown")).alias("key")),
    )
    rows = failed.select("ts", F.inline(scopes)).where("key is not null")
    placed = greedy_windows(rows, ["scope", "key"], micros("ts"), F.lit(minutes * 60_000_000))
    counts = placed.groupBy(F.timestamp_micros("window_us").alias("window_start"), "scope", "key")
    limit = F.when(F.col("scope") == "user", limits["user"]).otherwise(limits["ip"])
    return counts.agg(F.count("*").alias("failures")).withColumn("reached", F.col("failures") >= limit)
