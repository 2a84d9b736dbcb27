"""Quality rules whose thresholds follow each language and source.

Measures of a text are put into a mergeable quantile sketch per (language, source): counts of
buckets whose width grows with the value, by integer arithmetic alone, so that sketches of parts add
up to the sketch of the whole whatever the order. Fences come from the quartiles of a group; a group
with little support takes the merged sketch of its language, then of all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import small_side
from flowloom.session import cut_lineage

WINDOW = 8
#: Fixed rules that come before the adaptive ones: fewer words, or a larger share (%) of repeats.
MIN_WORDS, MAX_REPEATED = 20, 30
#: Values below 2^BITS have buckets of their own, larger ones keep BITS leading bits.
BITS = 6
#: Rows a group needs for quartiles of its own.
SUPPORT = 30
#: A fence lies SPREAD times the distance of the quartiles beyond the upper (lower) one, plus a slack.
SPREAD = 3
#: Measure -> slack of its fence, in the measure's unit (thousandths, per word, of what it counts).
SLACK = {"word_length": 1000, "symbols": 100, "dup_lines": 50, "repeated": 100}

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Measure -> what it counts, per word.
COUNTED = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeated": "n_repeat_words"}
BOTH_SIDES = {"word_length"}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that stand at least twice in the text, all copies counted."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        mixed ^= mixed >> np.uint64(29)
    _, group, count = np.unique(mixed, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(count[group] > 1)
    if not len(maybe):
        return 0
    seen: dict[tuple, list[int]] = {}  # equal hashes are only candidates
    for start in maybe.tolist():
        seen.setdefault(tuple(words[start : start + WINDOW]), []).append(start)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.array(starts) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def measure(texts: pd.Series) -> pd.DataFrame:
    """The columns of BASE for each text. Words are parted by ASCII white space."""
    rows = []
    for text in texts:
        raw = text.encode("utf-8", "replace") if text else b""
        words = raw.split()
        spaces = len(raw) - len(raw.translate(None, SPACES))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        rows.append((len(words), len(text or "") - spaces, symbols, duplicate_lines(raw), repeated_words(words)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in BASE.split(", ")])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def with_measures(base: DataFrame) -> DataFrame:
    for name, column in COUNTED.items():
        base = base.withColumn(name, F.expr(f"({column} * 1000) div greatest(n_words, 1L)"))
    return base


def sketches(measured: DataFrame) -> DataFrame:
    """The mergeable part: lang, source, measure, bucket (its smallest value), n. Texts without words
    have no measures."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in COUNTED]))
    rows = measured.where("n_words > 0").select("lang", "source", each.alias("x")).select("lang", "source", "x.*")
    shift = f"greatest(length(bin(value)) - {BITS}, 0)"
    bucket = F.expr(f"shiftleft(shiftright(value, {shift}), {shift})").alias("bucket")
    return rows.groupBy("lang", "source", "measure", bucket).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q3 and support n of each measure, from sketches merged by `keys`.

    A group has at most some thousand buckets, however many rows it stands for.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    below = Window.partitionBy(*keys, "measure").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(below))
    total = Window.partitionBy(*keys, "measure")
    ranked = ranked.withColumn("total", F.sum("n").over(total))
    return ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        F.max("total").alias("support"),
    )


def fences(sketch: DataFrame) -> DataFrame:
    """A row per (lang, source): lower and upper fence of every measure."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select("lang", "measure", F.struct("q1", "q3", "support").alias("in_lang"))
    overall = quartiles(sketch, []).select("measure", F.struct("q1", "q3").alias("in_all"))
    joined = own.join(small_side(by_lang), ["lang", "measure"]).join(F.broadcast(overall), "measure")
    chosen = (
        F.when(F.col("support") >= SUPPORT, F.struct("q1", "q3"))
        .when(F.col("in_lang.support") >= SUPPORT, F.struct("in_lang.q1", "in_lang.q3"))
        .otherwise(F.col("in_all"))
    )
    quarter = joined.select("lang", "source", "measure", chosen.alias("q"))
    out = []
    for name, slack in SLACK.items():
        beyond = SPREAD * (F.col("q.q3") - F.col("q.q1")) + slack
        here = F.col("measure") == name
        out.append(F.max(F.when(here, F.col("q.q3") + beyond)).alias(f"{name}_most"))
        if name in BOTH_SIDES:
            out.append(F.max(F.when(here, F.col("q.q1") - beyond)).alias(f"{name}_least"))
    return quarter.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """A row per row of `docs` (doc_id, text, lang, source): doc_id, lang, source, the columns of BASE,
    the measures and their fences, base_failed, kept.

    kept is false for texts that fail the fixed rules, and for those with a measure beyond a fence of
    their language and source. Null texts are empty: no words, base_failed. Null languages and sources
    are taken as "". Repeated rows all count and are judged alike; an empty table gives an empty
    result; other columns are left out.
    """
    measured = F.pandas_udf(measure, BASE)("text").alias("base")
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    base = with_measures(cut_lineage(docs.select("doc_id", *name, measured).select("doc_id", "lang", "source", "base.*")))
    limits = fences(cut_lineage(sketches(base)))
    kept = ~base_failed()
    for m in COUNTED:
        kept &= F.col(m) <= F.col(f"{m}_most")
        if m in BOTH_SIDES:
            kept &= F.col(m) >= F.col(f"{m}_least")
    judged = base.join(small_side(limits), ["lang", "source"], "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(kept, F.lit(False)))
