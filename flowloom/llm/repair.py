"""Repair of the turn structure of conversations by a rank-convergence parallel Viterbi.

A conversation's rows are edited, at least cost, until the initials of its roles read (s?(ua)+)?.
Costs to the end are a vector over four states; one row maps the vector behind it to the vector before
it. Vectors that differ by a constant lead to the same edits, and up to a constant only some dozens of
them can occur (`VECTORS`), so a vector is a small number and a row a look-up.

Conversations are cut into chunks of bounded size. Every chunk runs backwards from a speculative
vector; fix-up passes rerun chunks from the vector their successor arrived at, until old and new
vector differ by a constant only, and end when no chunk's own vector moves. Edits are then traced
forwards through the stitched vectors, the least letter first wherever several are cheapest.
"""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import discard, stored

WORD_CHAR = r"[^\x20\x09-\x0D]"
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: States: nothing written yet, after system, after user, after assistant; the first and last may end.
STATES, KINDS = 4, "sua"
#: Where an inserted or renamed row leads from each state, and the role it has there.
TURNS_TO, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Rows that can be kept, and code points of text, in a chunk.
ROWS, CHARS = 4096, 1 << 22
#: Fix-up passes before chunks that still differ are closed by composing their maps.
PASSES = 4
FAULTS = ("blank", "duplicate", "truncated")


# -- costs ---------------------------------------------------------------------------------------


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[TURNS_TO[s]]) for s, c in enumerate(costs)]
    return costs


def _even(costs: list[int]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


def _options(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row in ASCII order; code is 2 * kind + whether it is cut off."""
    extra = CUT_OFF * (code & 1)
    kept = KEEPS.get((state, "sua-"[code >> 1]))
    keep = [] if kept is None else [("K", extra, kept)]
    return [("D", DELETE, state), *keep, ("R", REROLE + extra, TURNS_TO[state])]


def _before(code: int, after: tuple[int, ...]) -> list[int]:
    return _with_inserts([min(cost + after[to] for _, cost, to in _options(code, s)) for s in range(STATES)])


CODES = range(2 * len("sua-"))
END = _even(_with_inserts([0, 99, 99, 0]))
FLAT = (0,) * STATES


def _reachable() -> list[tuple[int, ...]]:
    found = [END, FLAT]
    for vector in found:
        for code in CODES:
            before = _even(_before(code, vector))
            if before not in found:
                found.append(before)
    return found


VECTORS = _reachable()
#: Vector number behind a row of a code -> vector number before it.
BACK = [[VECTORS.index(_even(_before(code, v))) for code in CODES] for v in VECTORS]


def run_back(codes: bytes, end: int) -> int:
    for code in reversed(codes):
        end = BACK[end][code]
    return end


def rerun(codes: bytes, old_end: int, new_end: int, old_start: int) -> int:
    """The vector before the chunk from a new one behind it; stops where both runs meet."""
    for code in reversed(codes):
        if old_end == new_end:
            return old_start
        old_end, new_end = BACK[old_end][code], BACK[new_end][code]
    return new_end


@cache
def _edits(state: int, code: int, behind: int) -> tuple[str, tuple[str | None, ...], int, int]:
    """Least cheapest edits around one row: letters, roles written (None: the row's own), cost, state."""
    after = VECTORS[behind]
    before = _before(code, after)
    letters, roles, spent = "", (), 0
    while True:
        choices = [(e, c, to, after[to]) for e, c, to in _options(code, state)]
        choices.append(("I", INSERT, TURNS_TO[state], before[TURNS_TO[state]]))
        edit, cost, to = next((e, c, to) for e, c, to, rest in sorted(choices) if c + rest == before[state])
        letters, spent, state = letters + edit, spent + cost, to
        if edit in "IR":
            roles += ((edit, ROLE[to]),)
        elif edit == "K":
            roles += ((edit, None),)
        if edit != "I":
            return letters, roles, spent, state


def _vectors_behind(codes: bytes, end: int) -> list[int]:
    behind = []
    for code in reversed(codes):
        behind.append(end)
        end = BACK[end][code]
    return behind[::-1]


def states_after(codes: bytes, end: int) -> list[int]:
    """The state behind the chunk for each state before it."""
    out = list(range(STATES))
    for code, behind in zip(codes, _vectors_behind(codes, end)):
        out = [_edits(s, code, behind)[3] for s in out]
    return out


class Closing(NamedTuple):
    letters: str
    roles: tuple[str, ...]
    cost: int


#: What is inserted at the end of a conversation, by the state there.
CLOSING = (Closing("", (), 0), Closing("II", ("user", "assistant"), 6), Closing("I", ("assistant",), 3), Closing("", (), 0))


# -- rows ----------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's test damage: the rows that are left, and the ids of which a row was dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"),
        spaced("text").alias("text"),
        (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("hit"),
    )
    hit, text = F.col("hit"), F.col("text")
    changed = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    left = rows.where("hit <> 0").select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy"),
    )
    return left.drop("copy"), rows.where("hit = 0").select("conv_id").distinct()


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same &= left[key].eqNullSafe(right[f"_{key}"])
    return same


def marked(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Distinct rows with n (how often they stand there) and fault (0, or 1 + place in FAULTS).

    Rows that are equal in all of conversation, turn, role and text stand next to each other, all but
    the first being duplicates. An id of `ids` gets a row with n = 0.
    """
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    # where a role and text first stand in a conversation; nulls come first
    first = rows.groupBy("conv_id", "role", "hash").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("none"))
    first = first.select(
        F.col("conv_id").alias("_conv_id"),
        F.when(~F.col("none"), F.col("least")).alias("_turn"),
        F.col("role").alias("_role"),
        F.col("hash").alias("_hash"),
        F.lit(True).alias("_first"),
    )
    rows = rows.join(first, _same(rows, first, ["conv_id", "turn", "role", "hash"]), "left")
    fault = (
        F.when(~F.col("text").rlike(WORD_CHAR), 1)
        .when(F.col("_first").isNull(), 2)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), 3)
        .otherwise(0)
    )
    rows = rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    if ids is None:
        return rows
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    return rows.unionByName(ids.select("conv_id", *none, F.lit(0).cast("long").alias("n"), F.lit(0).alias("fault")))


COUNTS = ("rows", *FAULTS, "illegal", "turns")


def _chunk_type(conv_type: T.DataType) -> T.StructType:
    kinds = {
        "conv_id": conv_type, "id": T.LongType(), "opens": T.BooleanType(), "follows": T.BooleanType(), "codes": T.BinaryType(),
        "ahead": T.ArrayType(T.LongType()), "tail": T.LongType(), "roles": T.ArrayType(T.StringType()), "texts": T.ArrayType(T.StringType()),
        **{c: T.LongType() for c in COUNTS}, "low": T.LongType(), "high": T.LongType(), "head_role": T.StringType(), "last_role": T.StringType(),
    }
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


def _legal(one: str, two: str) -> bool:
    return one[:1] + two[:1] in ("su", "ua", "au")


def _cutter(schema: pa.Schema, most_rows: int, most_chars: int):
    def cut(batches):
        """Chunks of a partition's sorted rows. Rows that must go are counts, so a chunk holds at most
        `most_rows` others; only a conversation of which no other row is here has an empty chunk."""
        part = TaskContext.get().partitionId()
        seq, out, now, chars = 0, [], None, 0

        def fresh(conv, opens):
            nonlocal seq, chars
            seq, chars = seq + 1, 0
            counts = dict.fromkeys(COUNTS, 0)
            return {"conv_id": conv, "id": (part << 32) + seq - 1, "opens": opens, "follows": False, "codes": bytearray(), "ahead": [], "tail": 0,
                    "roles": [], "texts": [], **counts, "low": None, "high": None, "head_role": None, "last_role": None}

        def flush():
            rows = [c | {"codes": bytes(c["codes"])} for c in out]
            out.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault")]
            for conv, turn, role, text, n, fault in zip(*columns):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        out.append(now)
                        held += chars
                    now = fresh(conv, True)
                stays = n and fault in (0, 3)
                if stays and (len(now["codes"]) >= most_rows or now["codes"] and chars + len(text) > most_chars):
                    now["follows"] = True
                    out.append(now)
                    held += chars
                    now = fresh(conv, False)
                if len(out) >= 1000 or held > most_chars:
                    yield flush()
                    held = 0
                if not n:
                    continue
                if now["last_role"] is None:
                    now["head_role"] = role
                else:
                    now["illegal"] += not _legal(now["last_role"], role)
                now["illegal"] += n - 1
                now["last_role"] = role
                if turn is not None and turn != now["high"]:
                    now["turns"] += 1
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                now["rows"] += n
                if fault:
                    now[FAULTS[fault - 1]] += 1
                now["blank" if fault == 1 else "duplicate"] += n - 1
                if stays:
                    kind = (KINDS + role[:1]).index(role[:1]) if role else len(KINDS)
                    now["codes"].append(2 * kind + (fault == 3))
                    now["ahead"].append(now["tail"])
                    now["tail"] = n - 1
                    now["roles"].append(role)
                    now["texts"].append(text)
                    chars += len(text)
                else:
                    now["tail"] += n
        if now is not None:
            out.append(now)
        if out:
            yield flush()

    return cut


# -- chunks --------------------------------------------------------------------------------------


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _each(fn, names: list[str], schema: T.StructType):
    """A function of Arrow batches that calls `fn` with each row's `names` and yields its rows."""
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            rows = [fn(*values) for values in zip(*[batch.column(n).to_pylist() for n in names])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _mapped(df: DataFrame, fn, names: list[str], schema: str) -> DataFrame:
    kind = T.StructType.fromDDL(schema)
    return df.mapInArrow(_each(fn, names, kind), kind)


def chunks(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """`marked` rows as a stored table of chunks with `next`, the next chunk that has rows to keep, and
    `alone`: whether it is its conversation's only chunk.

    Rows are dealt out by ranges of (conversation, turn, role, start of the text), so that a long
    conversation spans many tasks. The driver gets two small rows for each of these.
    """
    schema = _chunk_type(rows.schema["conv_id"].dataType)
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = stored(dealt.mapInArrow(_cutter(_arrow(schema), most_rows, most_chars), schema), "turn-chunks")
    edge = F.struct(F.col("id"), F.col("conv_id"), (F.length("codes") > 0).alias("active"))
    by_part = cut.select(F.shiftright("id", 32).alias("part"), "id", edge.alias("edge"))
    ends = by_part.groupBy("part").agg(F.min_by("edge", "id").alias("first"), F.max_by("edge", "id").alias("last")).orderBy("part").collect()
    spanning, links = [], []
    for i, at in enumerate(ends[:-1]):
        if at.last.conv_id == ends[i + 1].first.conv_id:
            spanning.append((at.last.conv_id,))
        if at.last.active:
            for later in ends[i + 1 :]:
                if later.first.conv_id != at.last.conv_id:
                    break
                if later.first.active:
                    links.append((at.last.id, later.first.id))
                    break
                if later.first.id != later.last.id:
                    break
    spark = rows.sparkSession
    links = F.broadcast(spark.createDataFrame(links, "id long, linked long"))
    spans = T.StructType([T.StructField("_conv_id", schema["conv_id"].dataType), T.StructField("spans", T.BooleanType())])
    spans = F.broadcast(spark.createDataFrame([(c, True) for (c,) in dict.fromkeys(spanning)], spans))
    out = cut.join(links, "id", "left").join(spans, _same(cut, spans, ["conv_id"]), "left")
    out = out.withColumn("next", F.when(F.col("follows"), F.col("id") + 1).otherwise(F.col("linked")))
    alone = F.col("opens") & ~F.col("follows") & F.col("spans").isNull()
    out = out.withColumn("alone", alone).drop("linked", "spans", "_conv_id")
    out.stored_at = cut.stored_at
    return out


def resolve(maps: DataFrame) -> DataFrame:
    """id, value of `maps` (id, link, map): value = map[value of link], or map[0] where link is null.

    Maps are composed along the links, each time over twice the distance; one whose entries are all
    equal needs no link any more.
    """
    settled = F.size(F.array_distinct("map")) == 1
    cut = lambda df: stored(df.withColumn("link", F.when(~settled, F.col("link"))), "turn-maps")
    maps = cut(maps.select("id", "link", "map"))
    while not maps.where("link is not null").isEmpty():
        far = maps.select(F.col("id").alias("link"), F.col("link").alias("further"), F.col("map").alias("inner"))
        step = maps.join(far, "link", "left")
        joined = F.transform("inner", lambda i: F.get(F.col("map"), i))
        onward = cut(step.select("id", F.col("further").alias("link"), F.coalesce(joined, F.col("map")).alias("map")))
        discard(maps)
        maps = onward
    return maps.select("id", F.get("map", F.lit(0)).alias("value"))


def ends_by_convergence(linked: DataFrame, passes: int = PASSES) -> DataFrame:
    """id, end: the vector behind each chunk of `linked` (id, next, codes), by speculation and fix-up.

    Vectors of chunks that still move after `passes` come from `resolve`.
    """
    guess = F.when(F.col("next").isNull(), F.lit(VECTORS.index(END))).otherwise(F.lit(VECTORS.index(FLAT)))
    names = ["id", "next", "codes", "end"]
    state_type = "id long, next long, end int, start int"
    speculate = lambda i, n, codes, end: {"id": i, "next": n, "end": end, "start": run_back(codes, end)}
    state = stored(_mapped(linked.withColumn("end", guess), speculate, names, state_type), "turn-vectors")
    told = lambda: state.select(F.col("id").alias("next"), F.col("start").alias("told"))
    for left in range(passes, -1, -1):
        stale = state.join(told(), "next").where("told <> end")
        if stale.isEmpty():
            return state.select("id", "end")
        if not left:
            break
        again = stale.join(linked.select("id", "codes"), "id")
        fix = lambda i, n, codes, old, new, start: {"id": i, "next": n, "end": new, "start": rerun(codes, old, new, start)}
        fixed = _mapped(again, fix, ["id", "next", "codes", "end", "told", "start"], state_type)
        moved = stored(state.join(stale.select("id"), "id", "left_anti").unionByName(fixed), "turn-vectors")
        discard(state)
        state = moved
    whole = lambda i, link, codes: {"id": i, "link": link, "map": [run_back(codes, VECTORS.index(END) if link is None else v) for v in range(len(VECTORS))]}
    maps = _mapped(linked.withColumnRenamed("next", "link"), whole, ["id", "link", "codes"], "id long, link long, map array<int>")
    start = resolve(maps)
    behind = linked.select("id", "next").join(start.select(F.col("id").alias("next"), "value"), "next", "left")
    discard(state)
    return behind.select("id", F.coalesce("value", F.lit(VECTORS.index(END))).alias("end"))


def states_before(linked: DataFrame) -> DataFrame:
    """id, state before each chunk of `linked` (id, next, codes, end): maps of states, composed."""
    before = linked.where("next is not null").select(F.col("next").alias("id"), F.col("id").alias("link"))
    after = lambda i, link, codes, end: {"id": i, "link": link, "map": states_after(codes, end)}
    maps = _mapped(linked.join(before, "id", "left"), after, ["id", "link", "codes", "end"], "id long, link long, map array<int>")
    value = resolve(maps).select(F.col("id").alias("link"), "value")
    return before.join(value, "link").select("id", F.col("value").alias("state"))


TRACED = "conv_id {conv}, id long, audit string, cost long, repaired array<struct<role:string,text:string>>, state int, {counts}, low long, high long, head_role string, last_role string"


def _trace(codes, ahead, tail, roles, texts, end, state):
    audit, cost, repaired = [], 0, []
    for code, skip, role, text, behind in zip(codes, ahead, roles, texts, _vectors_behind(codes, end)):
        letters, written, spent, state = _edits(state, code, behind)
        audit.append("D" * skip + letters)
        cost += spent + skip * DELETE
        repaired += [{"role": new or role, "text": "" if edit == "I" else text} for edit, new in written]
    audit.append("D" * tail)
    return "".join(audit), cost + tail * DELETE, repaired, state if codes else None


def traced(ready: DataFrame) -> DataFrame:
    """Edits and repaired rows of chunks with `end` and `state`; `state` then is the one behind the
    chunk (null if it has no rows to keep). What closes the conversation is still missing."""
    rest = [*COUNTS, "low", "high", "head_role", "last_role"]
    names = ["conv_id", "id", "codes", "ahead", "tail", "roles", "texts", "end", "state", *rest]

    def row(conv, i, codes, ahead, tail, roles, texts, end, state, *others):
        audit, cost, repaired, state = _trace(codes, ahead, tail, roles, texts, end, state)
        return {"conv_id": conv, "id": i, "audit": audit, "cost": cost, "repaired": repaired, "state": state, **dict(zip(rest, others))}

    schema = TRACED.format(conv=ready.schema["conv_id"].dataType.simpleString(), counts=", ".join(f"{c} long" for c in COUNTS))
    return _mapped(ready, row, names, schema)


def repair(turns: DataFrame, ids: DataFrame | None = None, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """Cheapest edits of the conversations in `turns` (conv_id, turn, role, text), a row per chunk.

    In the order of id, a conversation's chunks give its audit (letters of the edits), cost and
    repaired rows (role, text); the last state that is not null tells by `CLOSING` what is still to be
    inserted. `ids` are conversations that get a row even if they have no turn. `whole` tells whether
    the chunk is its conversation's only one.

    Rows stand in the order of turn (null first), role, text; null roles and texts are one space. Equal
    rows are kept apart and count as duplicates of the first. An empty role is none of system, user and
    assistant. A null conv_id is a conversation of its own. Other columns are left out; an empty table
    gives an empty result. Texts of any length stay whole: a chunk holds one at least.
    """
    cut = chunks(marked(turns, ids), most_rows, most_chars)
    start, end = F.lit(0).alias("state"), F.lit(VECTORS.index(END)).alias("end")
    whole = traced(cut.where("alone").select("*", end, start)).withColumn("whole", F.lit(True))
    several = cut.where("not alone")
    if several.isEmpty():
        return whole
    active = several.where(F.length("codes") > 0).select("id", "next", "codes")
    ends = stored(active.join(ends_by_convergence(active), "id"), "turn-ends")
    known = ends.select("id", "end").join(states_before(ends), "id", "left")
    rest = several.join(known, "id", "left").fillna({"state": 0, "end": VECTORS.index(END)})
    return whole.unionByName(traced(rest).withColumn("whole", F.lit(False)))


# -- digests -------------------------------------------------------------------------------------

DIGEST = {
    "gaps": T.LongType(), "blank": T.LongType(), "duplicate": T.LongType(), "truncated": T.LongType(), "illegal": T.LongType(),
    "cost": T.LongType(), "audit": T.StringType(), "repaired_sha256": T.StringType(),
}


def _folder(schema: pa.Schema):
    def fold(batches):
        """One row per conversation from its chunks in order. The hash takes repaired rows one by one."""
        now, out = None, []

        def write(role, text):
            now["sha"].update(("\n" if now["any"] else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
            now["any"] = True

        def close():
            closing = CLOSING[now["state"]]
            for role in closing.roles:
                write(role, "")
            gaps = 0 if now["high"] is None else now["high"] - now["low"] + 1 - now["turns"]
            counts = {c: now[c] for c in (*FAULTS, "illegal")}
            audit = "".join(now["audit"]) + closing.letters
            out.append({"conv_id": now["conv_id"], "gaps": gaps, **counts, "cost": now["cost"] + closing.cost, "audit": audit, "repaired_sha256": now["sha"].hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        close()
                    counts = dict.fromkeys((*COUNTS, "cost"), 0)
                    now = {"conv_id": row["conv_id"], "sha": hashlib.sha256(), "any": False, "state": 0, "audit": [], "low": None, "high": None, "last_role": None, **counts}
                now["audit"].append(row["audit"])
                for count in (*COUNTS, "cost"):
                    now[count] += row[count]
                if row["rows"]:
                    if now["last_role"] is not None:
                        now["illegal"] += not _legal(now["last_role"], row["head_role"])
                    now["last_role"] = row["last_role"]
                if row["high"] is not None:
                    now["turns"] -= row["low"] == now["high"]
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                if row["state"] is not None:
                    now["state"] = row["state"]
                for turn in row["repaired"]:
                    write(turn["role"], turn["text"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return fold


def digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation of `repair`: counts of faults, cost, audit and hash of the repaired rows.

    A hash reads its text from start to end, so the chunks of a conversation that has several pass
    through one task, one after the other; its rows themselves do not meet.
    """
    schema = T.StructType([T.StructField("conv_id", repaired.schema["conv_id"].dataType), *[T.StructField(k, t) for k, t in DIGEST.items()]])
    fold = _folder(_arrow(schema))
    whole = repaired.where("whole").mapInArrow(fold, schema)
    several = repaired.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "id")
    return whole.unionByName(several.mapInArrow(fold, schema))
