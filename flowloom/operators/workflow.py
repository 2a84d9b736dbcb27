"""Replay of analyst actions on alerts.

Each action asks for a status; it succeeds when the move is allowed from the status the alert has
then. An action is a map from the five statuses to the five statuses, and maps compose, so an alert
with very many actions is cut into blocks: every block reduces to one map, the maps give the status
at the start of each block, and the blocks are then replayed on their own. A map is one integer with
three bits for each status, so that all of it is native expressions over arrays of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.scan import id_block
from flowloom.registry import CLOSED_STATUSES, MOVES, ROLES, STATUSES

#: Rows or blocks that are folded at once, as a power of two, and how often blocks are grouped again.
BLOCK_BITS, LEVELS = 12, 3
MAP_BITS, MASK = 3, 7


def next_status(current: int, wanted: int, acknowledge: bool) -> int:
    """The status after one action; unchanged means rejected."""
    if acknowledge and STATUSES[current] != "NEW":
        return current
    return wanted if STATUSES[wanted] in MOVES[STATUSES[current]] else current


def packed(ends: list[int]) -> int:
    """A map of statuses as one integer."""
    return sum(end << MAP_BITS * start for start, end in enumerate(ends))


UNCHANGED = packed(list(range(len(STATUSES))))


def step_of(status: Column, action: Column) -> Column:
    """The map of an action; one that asks for no known status changes nothing."""
    maps = [packed([next_status(s, wanted, ack) for s in range(len(STATUSES))]) for wanted in range(len(STATUSES)) for ack in (False, True)]
    wanted = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int") - 1
    place = 2 * wanted + F.coalesce(action == "acknowledge", F.lit(False)).cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in maps]), place), F.lit(UNCHANGED))


def after_step(step: Column, status: Column) -> Column:
    return F.call_function("shiftright", step, status * MAP_BITS).bitwiseAND(F.lit(MASK))


def _then(first: Column, second: Column) -> Column:
    """The map of one after the other."""
    out = F.lit(0)
    for start in range(len(STATUSES)):
        end = after_step(second, F.shiftright(first, MAP_BITS * start).bitwiseAND(F.lit(MASK)))
        out = out.bitwiseOR(F.shiftleft(end, MAP_BITS * start))
    return out


def _statuses(steps: Column, start: Column) -> Column:
    """The status before the first of `steps`, and after each."""
    return F.aggregate(steps, F.array(start), lambda found, x: F.concat(found, F.array(after_step(x["step"], F.element_at(found, -1)))))


def _starts(maps: DataFrame, bits: int, levels: int) -> DataFrame:
    """alert_id, block, start: the status at the start of each block, from a map (`step`) per block."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "step"))).alias("steps")
    if levels == 1:
        grouped = maps.groupBy("alert_id").agg(ordered).withColumn("start", F.lit(STATUSES.index("NEW")))
    else:
        wider = F.shiftright("block", bits).alias("wider")
        grouped = maps.groupBy("alert_id", wider).agg(ordered)
        above = _starts(grouped.select("alert_id", F.col("wider").alias("block"), _fold("steps").alias("step")), bits, levels - 1)
        above = above.select("alert_id", F.col("block").alias("wider"), "start")
        grouped = grouped.join(above, ["alert_id", "wider"])
    walked = grouped.withColumn("walked", _statuses(F.col("steps"), F.col("start")))
    each = F.transform("steps", lambda x, i: F.struct(x["block"].alias("block"), F.get("walked", i).alias("start")))
    return walked.select("alert_id", F.inline(each))


def _fold(steps: str) -> Column:
    return F.aggregate(steps, F.lit(UNCHANGED), lambda done, x: _then(done, x["step"]))


def replay(actions: DataFrame, bits: int = BLOCK_BITS, levels: int = LEVELS) -> DataFrame:
    """Every action (alert_id, seq, action, status, ...) with the status before and after it and whether
    it was applied. A null or unknown status changes nothing; alert_id and seq must not be null, and the
    columns must be of types that can be ordered.

    At most 2**bits seqs are in a block, and as many blocks in one of the next level; beyond
    2**(bits * levels) seqs the blocks of the top level are more.
    """
    key = ["alert_id", id_block(F.col("seq"), bits).alias("block")]
    step = step_of(F.col("status"), F.col("action")).alias("step")
    in_order = lambda *columns: F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("steps")
    maps = actions.groupBy(*key).agg(in_order(step))
    starts = _starts(maps.select("alert_id", "block", _fold("steps").alias("step")), bits, levels)
    row = F.struct(*[F.col(c) for c in actions.columns]).alias("row")
    rows = actions.groupBy(*key).agg(in_order(step, row)).join(starts, ["alert_id", "block"])
    walked = rows.withColumn("walked", _statuses(F.col("steps"), F.col("start")))
    each = F.transform("steps", lambda x, i: F.struct(x["row"].alias("row"), F.get("walked", i).alias("from"), F.get("walked", i + 1).alias("to")))
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col(c) + 1)
    done = walked.select(F.inline(each)).select("row.*", name("from").alias("before"), name("to").alias("after"))
    return done.withColumn("applied", F.col("before") != F.col("after"))


def current_state(replayed: DataFrame) -> DataFrame:
    """Status, acknowledgement and resolution of every alert that had an action.

    The first applied action is the only one that leaves NEW; the last one sets the status, and
    closing it sets the resolution time that reopening clears.
    """
    applied = F.col("applied")
    act = F.struct("seq", "ts", "user_id", "after")
    first, last = F.min(F.when(applied, act)), F.max(F.when(applied, act))
    folded = replayed.groupBy("alert_id").agg(
        first.alias("first"), last.alias("last"), F.count_if("applied").alias("applied"),
        F.count_if(~applied).alias("rejected"),
    )
    closed = F.col("last.after").isin(*CLOSED_STATUSES)
    return folded.select(
        "alert_id",
        F.coalesce("last.after", F.lit("NEW")).alias("status"),
        F.col("first.user_id").alias("acknowledged_by_id"),
        F.col("first.ts").alias("acknowledged_at"),
        F.when(closed, F.col("last.ts")).alias("resolved_at"),
        "applied",
        "rejected",
    )


def audit_rows(replayed: DataFrame) -> DataFrame:
    """Audit rows of the applied actions, with the status before and after."""
    name = F.when(F.col("action") == "acknowledge", "alert.acknowledged").otherwise("alert.status_changed")
    noted = F.coalesce(F.length("note") > 0, F.lit(False)) if "note" in replayed.columns else F.lit(False)
    return replayed.filter("applied").select(
        "seq",
        "ts",
        F.col("user_id").alias("actor_id"),
        name.alias("action"),
        F.lit("alert").alias("entity_type"),
        F.col("alert_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("before").alias("status"))).alias("before"),
        F.to_json(F.struct(F.col("after").alias("status"), noted.alias("note"))).alias("after"),
    )


def refused(replayed: DataFrame) -> DataFrame:
    return replayed.filter(~F.col("applied")).select("seq", "alert_id", "before", "status", "action")


def valid_note(body: Column) -> Column:
    return F.length(F.trim(body)).between(1, 5000)


def add_notes(notes: DataFrame) -> DataFrame:
    """Trimmed notes of 1 to 5000 characters; the others are left to the caller to reject."""
    return notes.filter(valid_note(F.col("body"))).withColumn("body", F.trim("body"))


def note_audit(notes: DataFrame) -> DataFrame:
    return notes.select(
        F.col("author_id").alias("actor_id"),
        F.lit("alert.note_added").alias("action"),
        F.lit("alert").alias("entity_type"),
        F.col("alert_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("id").alias("note_id"))).alias("after"),
    )


def eligible(users: DataFrame) -> DataFrame:
    """Active users of rank analyst or higher."""
    able = ROLES[ROLES.index("analyst") :]
    return users.filter(F.col("is_active") & F.col("role").isin(*able))


def assignments(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (seq, alert_id, user_id or null) with `accepted`; clearing always is."""
    able = eligible(users).select(F.col("id").alias("user_id"), F.lit(True).alias("_able"))
    joined = requests.join(able, "user_id", "left")
    accepted = F.col("user_id").isNull() | F.coalesce("_able", F.lit(False))
    return joined.withColumn("accepted", accepted).drop("_able")


def current_assignee(decided: DataFrame) -> DataFrame:
    """The last accepted request of each alert wins."""
    last = F.max(F.struct("seq", "user_id"))
    return decided.filter("accepted").groupBy("alert_id").agg(last.alias("l")).select(
        "alert_id", F.col("l.user_id").alias("assigned_to_id")
    )
