"""Flows from a packet stream: keyed state with event-time timers.

The state of a conversation is its open flow and the sums of the part that is being filled. Every
micro-batch reports that part as it stands, so a flood shows while it runs; a part is closed by a
packet of a later one, or by a timer once the watermark passes the end of the part or the idle time.
The results are those of `operators.packets.build_flows`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowloom.operators.correlate import micros
from flowloom.operators.packets import ACTIVITY_SECONDS, FLAG_BITS, SECOND, TUPLE, with_conversation
from flowloom.registry import MEASURED
from flowloom.session import ROCKSDB

NONE = -1
WAYS = ("fwd", "bwd")
#: The open flow, the times that gaps are measured from, and the timer that is set.
FLOW = ("flow_id", "first", "a_sends", "last", "last_a", "last_b", "since", "timer")
#: What a part adds up, each with its start value.
PART = (
    {"part": NONE, "start": NONE, "end": NONE}
    | {f"{w}_{c}": 0 for w in WAYS for c in ("n", "bytes", "square", "max", "min", "side_n", "side_total")}
    | {"gap_n": 0, "gap_total": 0, "gap_max": 0, "gap_min": 0, "idle_n": 0, "idle_total": 0, "active_n": 0, "active_total": 0, "psh_fwd": 0}
    | dict.fromkeys(FLAG_BITS, 0)
    | {"win_fwd": NONE, "win_bwd": NONE, "gap_mean": 0.0, "gap_m2": 0.0}
)
STATE = ", ".join(f"{c} {'double' if c in ('gap_mean', 'gap_m2') else 'long'}" for c in (*FLOW, *PART))
COUNTS = ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_psh_flags", *(f"{n}_flag_count" for n in FLAG_BITS), "init_win_bytes_fwd", "init_win_bytes_bwd")
KEY_TYPES = "ip_a string, port_a int, ip_b string, port_b int, protocol int"
OUT = f"flow_id long, part long, {KEY_TYPES}, " + ", ".join(f"{f.name} {'long' if f.name in COUNTS else 'double'}" for f in MEASURED) + ", closed boolean"


def parts_of(rows: dict[str, np.ndarray], low: np.ndarray) -> list[dict]:
    """What each part adds up, for packets given as columns in order and the first row of each part. All
    parts are added up together: most have few packets."""
    add, least, most = (lambda v, f=f: f.reduceat(v, low) for f in (np.add, np.minimum, np.maximum))
    us, length, fwd, window, gap = (rows[c] for c in ("us", "length", "fwd", "window", "gap"))
    large, at = np.iinfo(np.int64).max, np.arange(len(us))
    out = {"part": rows["part"][low], "start": least(us), "end": most(us)}
    for way, mine in (("fwd", fwd), ("bwd", ~fwd)):
        sizes, sided = np.where(mine, length, 0), mine & (rows["side_gap"] >= 0)
        known = least(np.where(mine & (window != NONE), at, len(us)))
        n = add(mine.astype(np.int64))
        out |= {
            f"{way}_n": n,
            f"{way}_bytes": add(sizes),
            f"{way}_square": add(sizes * sizes),
            f"{way}_max": most(sizes),
            f"{way}_min": np.where(n > 0, least(np.where(mine, length, large)), 0),
            f"{way}_side_n": add(sided.astype(np.int64)),
            f"{way}_side_total": add(np.where(sided, rows["side_gap"], 0)),
            f"win_{way}": np.where(known < len(us), window[np.minimum(known, len(us) - 1)], NONE),
        }
    seen = gap >= 0
    n, total = add(seen.astype(np.int64)), add(np.where(seen, gap, 0))
    mean = total / np.maximum(n, 1)
    away = np.where(seen, gap - np.repeat(mean, np.diff(low, append=len(us))), 0.0)
    out |= {"gap_n": n, "gap_total": total, "gap_mean": mean, "gap_m2": add(away * away)}
    out |= {"gap_max": most(np.where(seen, gap, 0)), "gap_min": np.where(n > 0, least(np.where(seen, gap, large)), 0)}
    for name in ("idle", "active"):
        out |= {f"{name}_n": add((rows[name] > 0).astype(np.int64)), f"{name}_total": add(np.maximum(rows[name], 0))}
    for name, bit in FLAG_BITS.items():
        out[name] = add((rows["flags"] & bit != 0).astype(np.int64))
    out["psh_fwd"] = add((fwd & (rows["flags"] & FLAG_BITS["psh"] != 0)).astype(np.int64))
    columns = [out[c].tolist() for c in PART]
    return [dict(zip(PART, values)) for values in zip(*columns)]


def merged(old: dict, new: dict) -> dict:
    """What a part had added up and what it gets, together."""
    out = {c: old[c] + new[c] for c in PART}
    out |= {"part": new["part"], "start": min(old["start"], new["start"]), "end": max(old["end"], new["end"])}
    for name in (*WAYS, "gap"):
        held = [x for x in (old, new) if x[f"{name}_n"]]
        out[f"{name}_min"] = min((x[f"{name}_min"] for x in held), default=0)
        out[f"{name}_max"] = max(old[f"{name}_max"], new[f"{name}_max"])
    for way in WAYS:
        out[f"win_{way}"] = new[f"win_{way}"] if old[f"win_{way}"] == NONE else old[f"win_{way}"]
    n, away = max(out["gap_n"], 1), new["gap_mean"] - old["gap_mean"]
    out["gap_m2"] = old["gap_m2"] + new["gap_m2"] + away * away * old["gap_n"] * new["gap_n"] / n
    out["gap_mean"] = old["gap_mean"] + away * new["gap_n"] / n
    return out


def _deviation(n: int, total: int, square: int) -> float:
    return math.sqrt((n * square - total * total) / (n * (n - 1))) if n > 1 else 0.0


def features(part: dict) -> dict:
    """The measured features of a part."""
    mean = lambda total, n: total / n if n else 0.0
    n, total = part["fwd_n"] + part["bwd_n"], part["fwd_bytes"] + part["bwd_bytes"]
    out = {"flow_duration_s": (part["end"] - part["start"]) / SECOND}
    for way in WAYS:
        out[f"{way}_packets"], out[f"{way}_bytes"] = part[f"{way}_n"], part[f"{way}_bytes"]
        out[f"{way}_pkt_len_max"], out[f"{way}_pkt_len_min"] = float(part[f"{way}_max"]), float(part[f"{way}_min"])
        out[f"{way}_pkt_len_mean"] = mean(part[f"{way}_bytes"], part[f"{way}_n"])
        out[f"{way}_pkt_len_std"] = _deviation(part[f"{way}_n"], part[f"{way}_bytes"], part[f"{way}_square"])
        out[f"{way}_iat_total"] = part[f"{way}_side_total"] / SECOND
        out[f"{way}_iat_mean"] = mean(part[f"{way}_side_total"], part[f"{way}_side_n"]) / SECOND
        out[f"init_win_bytes_{way}"] = part[f"win_{way}"]
    spread = math.sqrt(part["gap_m2"] / (part["gap_n"] - 1)) if part["gap_n"] > 1 else 0.0
    out |= {f"{name}_flag_count": part[name] for name in FLAG_BITS}
    return out | {
        "flow_iat_mean": mean(part["gap_total"], part["gap_n"]) / SECOND,
        "flow_iat_std": spread / SECOND,
        "flow_iat_max": part["gap_max"] / SECOND,
        "flow_iat_min": part["gap_min"] / SECOND,
        "fwd_psh_flags": part["psh_fwd"],
        "pkt_len_mean": mean(total, n),
        "pkt_len_std": _deviation(n, total, part["fwd_square"] + part["bwd_square"]),
        "down_up_ratio": mean(part["bwd_n"], part["fwd_n"]),
        "active_mean": mean(part["active_total"], part["active_n"]) / SECOND,
        "idle_mean": mean(part["idle_total"], part["idle_n"]) / SECOND,
    }


class FlowState(StatefulProcessor):
    """State of one conversation. Times are microseconds."""

    def __init__(self, idle: int, active: int, pause: int):
        self.idle, self.active, self.pause = idle, active, min(idle, pause)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", STATE)

    def _read(self) -> dict:
        if self.state.exists():
            return dict(zip((*FLOW, *PART), self.state.get()))
        return dict.fromkeys(FLOW, NONE) | PART

    def _write(self, flow: dict) -> None:
        """Store the flow; its timer rings when the open part ends or the flow has been idle."""
        ends = [flow["last"] + self.idle]
        if flow["part"] != NONE:
            ends.append(flow["first"] + (flow["part"] + 1) * self.active)
        timer = min(ends) // 1000 + 1
        if timer != flow["timer"]:
            if flow["timer"] != NONE:
                self.handle.deleteTimer(flow["timer"])
            self.handle.registerTimer(timer)
        flow["timer"] = timer
        self.state.update(tuple(flow[c] for c in (*FLOW, *PART)))

    def _columns(self, rows: pd.DataFrame, flow: dict) -> dict[str, np.ndarray]:
        """Flow, part and gaps of every packet, given what came before."""
        us, seq, a = rows["us"].to_numpy(), rows["seq"].to_numpy(), rows["a_sends"].to_numpy()
        before = lambda old, values: np.maximum.accumulate(np.concatenate([[old], values]))[:-1]
        seen = before(flow["last"], us)
        opens = (seen == NONE) | (us > seen + self.idle)
        opener = np.maximum.accumulate(np.where(opens, np.arange(len(us)), -1))
        of = lambda old, values: np.where(opener < 0, old, values[np.maximum(opener, 0)])
        first = of(flow["first"], us)
        side = np.where(a, before(flow["last_a"], np.where(a, us, NONE)), before(flow["last_b"], np.where(a, NONE, us)))
        gap = np.where(seen >= first, us - seen, NONE)
        resumes = (seen == NONE) | (us > seen + self.pause)
        since = np.maximum(before(flow["since"], np.where(resumes, us, NONE)), first)
        paused = gap > self.pause
        return {
            "us": us, "flow_id": of(flow["flow_id"], seq), "first": first, "a_sends": of(flow["a_sends"], a.astype(np.int64)),
            "part": (us - first) // self.active, "fwd": a == (of(flow["a_sends"], a.astype(np.int64)) == 1), "length": rows["length"].to_numpy(),
            "flags": rows["flags"].to_numpy(), "window": rows["window"].to_numpy(), "gap": gap, "side_gap": np.where(side >= first, us - side, NONE),
            "idle": np.where(paused, gap, 0), "active": np.where(paused, seen - since, 0),
            "a": a, "since": np.where(resumes, us, NONE),
        }

    def handleInputRows(self, key, rows, timerValues):
        """Packets of one conversation in one micro-batch, put into the order of arrival."""
        flow = self._read()
        packets = self._columns(pd.concat(list(rows)).sort_values("seq"), flow)
        same = (packets["flow_id"][1:] == packets["flow_id"][:-1]) & (packets["part"][1:] == packets["part"][:-1])
        low = np.concatenate([[0], np.flatnonzero(~same) + 1])
        parts = parts_of(packets, low)
        begun = [packets[c][low].tolist() for c in ("flow_id", "first", "a_sends")]
        out = []
        for part, flow_id, first, a_sends in zip(parts, *begun):
            if (flow_id, part["part"]) == (flow["flow_id"], flow["part"]):
                flow |= merged(flow, part)
                continue
            if flow["part"] != NONE:
                out.append(self._row(key, flow, True))
            flow |= part | {"flow_id": flow_id, "first": first, "a_sends": a_sends}
        latest = lambda rule: int(packets["us"][rule].max(initial=NONE))
        flow["last"] = max(flow["last"], latest(slice(None)))
        flow["last_a"], flow["last_b"] = max(flow["last_a"], latest(packets["a"])), max(flow["last_b"], latest(~packets["a"]))
        flow["since"] = max(flow["since"], int(packets["since"].max()))
        out.append(self._row(key, flow, False))
        self._write(flow)
        yield pd.DataFrame(out)[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """No packet of the open part can come any more; after the idle time none of the flow."""
        flow = self._read()
        if flow["part"] != NONE:
            yield pd.DataFrame([self._row(key, flow, True)])[COLUMNS]
        if expiredTimerInfo.getExpiryTimeInMs() * 1000 > flow["last"] + self.idle:
            self.state.clear()
            return
        flow |= PART | {"timer": NONE}
        self._write(flow)

    @staticmethod
    def _row(key, flow, closed):
        return dict(zip(TUPLE, key)) | {"flow_id": flow["flow_id"], "part": flow["part"], "closed": closed} | features(flow)

    def close(self) -> None:
        pass


COLUMNS = [part.split()[0] for part in OUT.split(", ")]


def stream_flows(
    packets: DataFrame,
    idle_seconds: float,
    active_seconds: float,
    seq: str = "event_id",
    ts: str = "ts",
    activity_seconds: float = ACTIVITY_SECONDS,
    late: str = "0 seconds",
) -> DataFrame:
    """Parts of flows as they grow: a row per conversation and micro-batch, and one when a part closes.

    Packets may be `late` against others; of one conversation they arrive in time order. Columns are
    those of `build_flows` and `closed`.
    """
    window = F.coalesce(F.col("tcp_window"), F.lit(NONE)) if "tcp_window" in packets.columns else F.lit(NONE)
    timed = packets.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = with_conversation(timed).select(
        *[F.col(part.split()[0]).cast(part.split()[1]) for part in KEY_TYPES.split(", ")],
        ts,
        F.col(seq).cast("long").alias("seq"),
        micros(ts).alias("us"),
        F.col("_a_sends").alias("a_sends"),
        F.col("length").cast("long").alias("length"),
        F.coalesce(F.col("tcp_flags"), F.lit(0)).cast("long").alias("flags"),
        window.cast("long").alias("window"),
    )
    processor = FlowState(*(int(x * SECOND) for x in (idle_seconds, active_seconds, activity_seconds)))
    return rows.groupBy(*TUPLE).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUT, outputMode="Update", timeMode="EventTime"
    )


def start_flows(packets: DataFrame, out: str, checkpoint: str, *timeouts: float, available_now: bool = True, **options) -> StreamingQuery:
    """Follow a packet stream and write `out`/flows, a folder for each micro-batch that a retry overwrites."""
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/flows/batch={batch_id}")

    writer = stream_flows(packets, *timeouts, **options).writeStream.outputMode("update").foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_flows(reports: DataFrame) -> DataFrame:
    """The last report of every part."""
    values = [c for c in COLUMNS if c not in ("flow_id", "part")]
    order = F.struct(F.col("fwd_packets") + F.col("bwd_packets"), "closed")
    last = reports.groupBy("flow_id", "part").agg(F.max_by(F.struct(*values), order).alias("last"))
    return last.select("flow_id", "part", "last.*")
