"""Live counters over packet streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.correlate import micros
from flowloom.operators.packets import SECOND, packet_alerts, trailing_count, traffic_totals
from flowloom.session import path_exists


def start_totals(scored: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Running packets, attacks, normal and share: one row, rewritten per micro-batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = traffic_totals(scored, threshold).writeStream.outputMode("complete").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_trailing_count(packets: DataFrame, out: str, checkpoint: str, seconds: int = 2) -> StreamingQuery:
    """Trailing count per source across micro-batches.

    What must be remembered is the last `seconds` of traffic; it is written beside the result of
    each micro-batch and read back by the next, so the count itself stays the batch operator, which
    no hot source can slow down.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_fresh", F.lit(True))
        last = f"{out}/tail/batch={batch_id - 1}"
        if path_exists(spark, last):  # not in the first micro-batch
            tail = spark.read.parquet(last).withColumn("_fresh", F.lit(False))
            rows = rows.unionByName(tail.select(rows.columns))
        rows = rows.persist()
        counted = trailing_count(rows, seconds).filter("_fresh").drop("_fresh")
        counted.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        edge = rows.agg(F.max(micros("ts"))).first()[0]
        if edge is not None:
            kept = rows.filter(micros("ts") >= edge - seconds * SECOND).drop("_fresh")
            kept.write.mode("overwrite").parquet(f"{out}/tail/batch={batch_id}")
        rows.unpersist()

    writer = packets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def start_packet_alerts(scored: DataFrame, out: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Alert rows as they happen, appended with exactly-once file commits."""
    writer = packet_alerts(scored, threshold).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
