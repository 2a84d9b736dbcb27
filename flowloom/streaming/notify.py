"""Rate-limited notifications from a stream of alert messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowloom.operators.correlate import micros
from flowloom.operators.risk import fitting_messages
from flowloom.session import ROCKSDB

SENT = "channel string, alert_id long, sent_us long, event_id long, risk_score int, held_before long"
COLUMNS = [part.split()[0] for part in SENT.split(", ")]


class RateLimit(StatefulProcessor):
    """State of one (channel, alert): when the last message was sent, and how many were held back since.

    It is forgotten once the watermark passes the end of the period, as any later message is sent.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sent_us long, held long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        """Messages of one micro-batch in the order of time; what is older than the last one sent is held."""
        messages = pd.concat(list(rows)).sort_values(["us", "event_id"])
        us, period = messages["us"].to_numpy(), int(messages["period"].iloc[0])
        sent, held, timer = self.last.get() if self.last.exists() else (None, 0, None)
        old, at, out = timer, 0, []
        while at < len(us):
            next_at = at if sent is None else int(np.searchsorted(us, sent + period))
            next_at = max(next_at, at)
            held += next_at - at
            if next_at == len(us):
                break
            sent, row = int(us[next_at]), messages.iloc[next_at]
            out.append((key[0], key[1], sent, int(row.event_id), int(row.risk_score), held))
            at, held = next_at + 1, 0
        timer = -(-(sent + period) // 1000)
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.last.update((sent, held, timer))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_notifications(messages: DataFrame, rules: dict[str, tuple[str, int]], late: str = "0 seconds") -> DataFrame:
    """Messages to send, as `operators.risk.notifications` picks them. held_before counts the messages of
    the channel and alert that were held back before this one and after the one sent last."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = fitting_messages(timed, rules).select("channel", "alert_id", "event_id", "ts", "risk_score", "period", micros("ts").alias("us"))
    return rows.groupBy("channel", "alert_id").transformWithStateInPandas(
        statefulProcessor=RateLimit(), outputStructType=SENT, outputMode="Append", timeMode="EventTime"
    )


def start_notifications(
    messages: DataFrame, rules: dict[str, tuple[str, int]], out: str, checkpoint: str, available_now: bool = True, late: str = "0 seconds"
) -> StreamingQuery:
    """Follow a stream of messages and write what to send to `out`, a folder per micro-batch that a retry overwrites."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream_notifications(messages, rules, late).writeStream.outputMode("append").foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
