import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowloom.llm import repair
from flowloom.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
WORD = r"[^\x20\x09-\x0D]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = [" " if x is None else x for x in (role, text)]
        hit = zlib.crc32(":".join(shown).encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows):
    """The result for one conversation's rows after damage, by a plain search over (row, state)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        last = re.findall(WORD, text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1
    need = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (1e9,)), (cost + 3, audit + "I", kept + ((full[to], ""),)))
        return best

    best = inserts({"": (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, *what):
            after[state] = min(after.get(state, (1e9,)), what)

        for state, (cost, audit, kept) in best.items():
            offer(state, cost + 4, audit + "D", kept)
            if fault in ("", "truncated"):
                cost += 3 * (fault == "truncated")
                if need[state].get(role[:1]):
                    offer(role[:1], cost, audit + "K", (*kept, (role, text)))
                to = "a" if state == "u" else "u"
                offer(to, cost + 3, audit + "R", (*kept, (full[to], text)))
        best = inserts(after)
    cost, audit, kept = min(best[s] for s in ("", "a") if s in best)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    shown = "\n".join(f"{r}:{t}" for r, t in kept)
    return {"gaps": gaps, **count, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(shown.encode()).hexdigest()}


def told(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


def expected(rows, ids=()):
    convs = {r[0] for r in rows} | set(ids)
    return {c: brute([r for r in rows if r[0] == c]) for c in convs}


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", " ", "", "unknown"]
TEXTS = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "é🙂.", "a .", "."]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(TEXTS)) for c in range(150) for _ in range(rng.randrange(1, 12))]
    rows += [(None, t, rng.choice(ROLES), rng.choice(TEXTS)) for t in range(5)]
    # one conversation with most rows, one of users alone, one of copies of one turn, one long text
    rows += [(900, t, rng.choice(ROLES[:3]), f"{rng.randrange(300)}.") for t in range(700)]
    rows += [(901, t, "user", f"{t}.") for t in range(120)]
    rows += [(902, t, "user", "Again.") for t in range(150)]
    rows += [(903, 1, "user", "word " * 60_000 + "."), (903, 2, "assistant", "Yes."), (903, 2, "assistant", "Yes."), (903, 7, "tool", "x" * 9000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_rows, partitions", [(4096, 4), (3, 9), (1, 2)])
def test_equal_to_brute_force(spark, mixed, most_rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(mixed, TURNS).withColumns({c: F.lit("x") for c in ("n", "fault", "id", "state", "hash", "rows")})
        found = told(repair.digests(repair.repair(frame, most_rows=most_rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == expected([(c, t, r, x) for c, t, r, x in mixed])


def test_repaired_rows_follow_the_pattern(spark, mixed):
    rows = repair.repair(spark.createDataFrame(mixed, TURNS), most_rows=50).orderBy("id").collect()
    letters = {}
    for row in rows:
        letters[row.conv_id] = letters.get(row.conv_id, "") + "".join(t.role[0] for t in row.repaired)
    assert len(letters) == 155
    assert all(re.fullmatch("s?(ua)*u?", x) for x in letters.values())


def test_vectors_that_never_meet_are_composed(spark):
    """Users alone keep the parity of what is left, so speculation is wrong in every second chunk."""
    rows = [(1, t, "user", f"{t}!") for t in range(61)] + [(2, t, "tool", f"{t}") for t in range(40)]
    found = told(repair.digests(repair.repair(spark.createDataFrame(rows, TURNS), most_rows=1)))
    assert found == expected(rows)


def test_fix_up_stops_where_vectors_meet():
    rng = random.Random(1)
    for _ in range(300):
        codes = bytes(rng.choice(repair.CODES) for _ in range(rng.randrange(12)))
        old, new = rng.randrange(len(repair.VECTORS)), rng.randrange(len(repair.VECTORS))
        assert repair.rerun(codes, old, new, repair.run_back(codes, old)) == repair.run_back(codes, new)


def test_damage_and_conversations_without_rows(spark, mixed):
    dropped = [c for c in range(5000, 6000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = mixed + [(c, 0, "user", "Hi.") for c in dropped] + [(None, None, None, None)]
    left, ids = repair.damage(spark.createDataFrame(rows, TURNS))
    found = told(repair.digests(repair.repair(left, ids)))
    kept = damaged(rows)
    assert found == expected(kept, {r[0] for r in rows})
    empty = found[dropped[0]]
    assert (empty["cost"], empty["audit"], empty["repaired_sha256"]) == (0, "", hashlib.sha256().hexdigest())


def test_empty_table(spark):
    left, ids = repair.damage(spark.createDataFrame([], TURNS))
    assert repair.digests(repair.repair(left, ids)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = told(QUERIES["op13_conversation_repair"](spark, folder))
    assert found == expected(damaged(rows), {r[0] for r in rows})
