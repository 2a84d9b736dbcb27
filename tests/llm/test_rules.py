import random
import re
from collections import Counter

from pyspark.sql import functions as F

from flowloom.llm import rules
from tests.llm.conftest import DOCS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def bucket(v):
    s = max(len(f"{v:b}") - rules.BITS, 0)
    return v >> s << s


def quartile(values, quarter):
    return next(b for i, b in enumerate(sorted(map(bucket, values)), 1) if i * 4 >= len(values) * quarter)


def brute(rows):
    """kept of each row."""
    bases = [base(t) for _, t, *_ in rows]
    groups = [(lang or "", source or "") for _, _, lang, source, _ in rows]
    at = {"word_length": 1, "symbols": 2, "dup_lines": 3, "repeated": 4}
    value = lambda b, m: b[at[m]] * 1000 // max(b[0], 1)
    out = []
    for b, (lang, source) in zip(bases, groups):
        ok = b[0] >= 20 and 100 * b[4] <= 30 * b[0]
        for m, slack in rules.SLACK.items():
            own = [value(x, m) for x, g in zip(bases, groups) if g == (lang, source) and x[0]]
            wide = [value(x, m) for x, g in zip(bases, groups) if g[0] == lang and x[0]]
            if not own:
                ok = False
                break
            pool = own if len(own) >= rules.SUPPORT else wide if len(wide) >= rules.SUPPORT else [value(x, m) for x in bases if x[0]]
            q1, q3 = quartile(pool, 1), quartile(pool, 3)
            beyond = rules.SPREAD * (q3 - q1) + slack
            ok = ok and value(b, m) <= q3 + beyond and (m not in rules.BOTH_SIDES or value(b, m) >= q1 - beyond)
        out.append(ok)
    return bases, out


def test_equal_to_brute_force(spark, odd_docs):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        text = prose(rng, rng.randrange(5, 120))
        if i % 11 == 0:
            text = text.replace(" ", "%% ")
        if i % 13 == 0:
            text = "\n".join([text[:70]] * 4 + [text])
        if i % 17 == 0:
            text = " ".join(w * 9 for w in text.split())
        rows.append((i, text, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", None]), 0))
    rows += [(200, None, "en", "a", 0), (201, " \n", "xx", "new", 0), (202, "é日 " * 30, "zz", "q", 0), (5, rows[5][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_words", "2 as measure", "'x' as bucket")
    bases, kept = brute(rows)
    got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.kept) for r in rules.judge(docs).collect())
    assert got == sorted(zip(bases, kept))
    assert rules.judge(odd_docs).count() == odd_docs.count()


def test_sketches_of_parts_add_up(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40), "en", "a", 0) for i in range(60)]
    names = ["lang", "source", "measure", "bucket"]

    def made(part):
        measured = F.pandas_udf(rules.measure, rules.BASE)("text").alias("b")
        frame = spark.createDataFrame(part, DOCS).select("lang", "source", measured)
        return rules.sketches(rules.with_measures(frame.select("lang", "source", "b.*")))

    whole = sorted(map(tuple, made(rows).collect()))
    parts = made(rows[:25]).unionByName(made(rows[25:])).groupBy(*names).sum("n")
    assert sorted(map(tuple, parts.collect())) == whole


def test_empty_table(spark, no_docs):
    assert rules.judge(no_docs).count() == 0
